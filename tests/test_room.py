"""Room for large tables: partitions by the size of the input, one shuffle less, compressed hand-offs."""

from pathlib import Path

import pytest

from glasspool.operators import positions
from testbed import derive

from .conftest import rows


@pytest.fixture
def settings(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    held = {name: spark.conf.get(name) for name in names}
    yield names
    for name, value in held.items():
        spark.conf.set(name, value)


def test_shuffle_partitions_follow_the_input(spark, tmp_path, monkeypatch, settings):
    spark.range(1000).withColumnRenamed("id", "l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    retail = derive.Retail(spark, str(tmp_path))
    partitions, *splits = settings
    before = [spark.conf.get(name) for name in settings]
    assert derive.make_room(retail) == int(before[0])
    assert [spark.conf.get(name) for name in settings] == before
    monkeypatch.setattr(derive, "ROWS_PER_PARTITION", 30)
    derive.Testbed(spark, str(tmp_path))
    assert spark.conf.get(partitions) == "34"
    assert {spark.conf.get(split) for split in splits} == {str(derive.SPLIT_BYTES)}
    monkeypatch.setattr(derive, "ROWS_PER_PARTITION", 300)
    derive.Testbed(spark, str(tmp_path))
    assert spark.conf.get(partitions) == "34"


def test_numbered_rows_meet_another_table(spark, workspace):
    lines = spark.createDataFrame([(k, s) for k in (1, 1, 2, None) for s in (5, 3)] + [(9, 1)], "k int, s int")
    owners = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (7, "d"), (None, "e")], "k int, o string")
    found = positions.numbered(lines, ["k"], ["s"], "n", workspace, beside=owners)
    assert found.columns == ["k", "s", "o", "n"]
    expected = [(1, 3, "a", 0), (1, 3, "a", 1), (1, 5, "a", 2), (1, 5, "a", 3)]
    expected += [(2, s, o, n) for n, s in enumerate((3, 5)) for o in "bc"]
    assert rows(found) == sorted(expected, key=repr)


def test_hand_offs_are_compressed_well(spark, workspace):
    workspace.table("small", lambda: spark.range(10))
    path = workspace.path("small")
    assert list(Path(path.removeprefix("file:")).glob("*.zstd.parquet"))
