"""Steps that shuffle or write less than before, with the same results."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glasspool import schema
from glasspool.operators import enrichment, normalize, positions
from glasspool.sources import snapshot, store
from glasspool.streaming import ingest

from .conftest import rows


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1, 40, 1_000_000])
def test_rows_of_large_and_small_keys_are_numbered_alike(spark, workspace, monkeypatch, most):
    monkeypatch.setattr(positions, "LARGE_KEY", most)
    found = [("hot", n) for n in range(90)] + [(f"k{n % 20}", n) for n in range(45)] + [(None, 1), (None, 2)]
    frame = spark.createDataFrame(found, "k string, s int").repartition(5)
    places, befores = {}, {}
    for key in {k for k, _ in found if k}:
        held = sorted(s for k, s in found if k == key)
        places |= {(key, s): place for place, s in enumerate(held)}
        befores |= {(key, s): before for before, s in zip([None, *held], held)}
    numbered = positions.numbered(frame, ["k"], ["s"], "n", workspace)
    assert {(k, s): n for k, s, n in rows(numbered)} == places and numbered.count() == len(places)
    owners = frame.select("k").distinct().withColumn("o", F.upper("k"))
    beside = positions.numbered(frame, ["k"], ["s"], "n", workspace, beside=owners)
    assert rows(beside) == sorted(((k, s, k.upper(), n) for (k, s), n in places.items()), key=repr)
    assert dict(beside.dtypes)["n"] == "bigint"
    previous = positions.previous(frame, ["k"], ["s"], "s", "p", workspace)
    assert {(k, s): p for k, s, p in rows(previous)} == befores and previous.count() == len(befores)


def test_small_keys_are_not_dealt_out_by_ranges(spark, workspace, monkeypatch):
    def ranges(*_):
        raise AssertionError("dealt out by ranges")

    monkeypatch.setattr(positions, "_placed", ranges)
    frame = spark.range(100).selectExpr("id % 7 AS k", "id AS s")
    assert positions.numbered(frame, ["k"], ["s"], "n", workspace).count() == 100
    assert positions.previous(frame, ["k"], ["s"], "s", "p", workspace).count() == 100


def test_sets_of_transactions_without_joinsplits_are_left_out(build):
    inputs = build.vin(("t1", "p", 0, ["a"], 1), ("t2", "p", 1, ["b"], 1))
    outputs = build.vout(("t1", 0, ["c"], 1), ("t3", 0, ["d"], 1))
    splits = build.joinsplits(("t1", 1, 0, None, None), ("t1", 2, 0, None, None), ("t4", 0, 1, None, None), (None, 3, 0, None, None))
    found = enrichment.with_joinsplit_addresses(splits, inputs, outputs)
    assert [(r[0], r[3], r[4]) for r in rows(found)] == [("t1", ["a"], ["c"])] * 2 + [("t4", None, None), (None, None, None)]
    assert "LeftSemi" in _plan(found)


def test_repeated_keys_are_found_by_bits(spark):
    def found(*keys):
        frame = spark.createDataFrame([(tx, n) for tx, n in keys], "vo_tx_hash string, vo_tx_n bigint")
        return snapshot._holds_repeated("vout", frame)

    apart = [("t", n) for n in (0, 1, 63, 64, 127, -1, -64, 1 << 40, None)] + [("u", 0), (None, 0), (None, None)]
    assert not found(*apart)
    assert all(found(*apart, key) for key in apart)
    heights = spark.createDataFrame([(1,), (2,)], "b_height bigint")
    assert not snapshot._holds_repeated("block", heights) and snapshot._holds_repeated("block", heights.union(heights))


def test_outputs_are_written_once_and_strays_are_counted(spark, build, workspace):
    """One pass deals out the outputs of a load and counts those of unknown transactions."""
    path = workspace.fresh_path("strays")
    clean = {
        "block": build.blocks(b1=1), "transaction": build.transactions(("t1", "b1", "public"), ("t2", "b9", "public")),
        "coingen": build.coingen(), "vin": build.frame(schema.VIN, []), "vjoinsplit": build.joinsplits(),
        "vout": build.vout(("t1", 0, ["a"], 1), ("t2", 0, ["b"], 1)),
    }
    snapshot.save_clean(spark, clean, path)
    assert [row["vo_tx_hash"] for row in snapshot.load_ledger(spark, path).vout.collect()] == ["t1"]
    with pytest.raises(snapshot.LoadRefused) as caught:
        snapshot.save_clean(spark, {**clean, "vout": clean["vout"].union(build.vout(("t7", 0, [], 1), ("t7", 1, [], 1)))}, path)
    assert caught.value.problems == [("vout", "no transaction", 2)]


def test_rows_are_left_out_after_they_are_dealt(spark, build, workspace):
    path, seen = workspace.fresh_path("dealt"), []

    def last(dealt):
        seen.append(dealt.columns)
        return dealt.filter("vo_tx_n = 0")

    stored = store.write_load(build.vout(("t", 0, ["a"], 1), ("t", 1, ["a"], 1)), path, "vout", "l", 4, last)
    assert stored.count() == 1 and "part" in seen[0]


def test_transactions_are_not_shuffled_to_meet_few_blocks(spark, build):
    listing = [f"t{n}" for n in range(60_000)]
    block = spark.createDataFrame([(1, "b1", 1, 4, listing, 0, "", "")], schema.BLOCK).coalesce(1)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        tables = {**build.ledger().tables(), "block": block, "transaction": build.transactions(("t1", "b1", "public"))}
        chosen = normalize.limit_height(tables, 5)["transaction"]
        assert "BroadcastHashJoin" in chosen._jdf.queryExecution().sparkPlan().toString()
        assert chosen.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_documents_are_narrowed_before_the_shuffle(spark):
    entry = "named_struct('value', 1BD, 'valueZat', 5L, 'n', 0L)"
    made = spark.sql(f"SELECT 't' AS txid, array({entry}) AS vout, array(named_struct('vpub_old', 1BD, 'vpub_new', 2BD, 'anchor', 'x')) AS vjoinsplit")
    found = ingest.narrowed(made)
    assert found.schema["vout"].dataType.elementType.names == ["value", "n"]
    assert found.schema["vjoinsplit"].dataType.elementType.names == ["vpub_old", "vpub_new"]
    assert ingest.narrowed(made.select("txid")).columns == ["txid"]


def test_documents_of_the_testbed_are_written_compressed(spark):
    from testbed import catalogue

    t = catalogue.open_testbed(spark, "/root/testdata/sf0.001")
    before = set(Path(t.workspace.root.removeprefix("file:")).glob("documents-*"))
    catalogue.QUERIES["json_flatten"](spark, "/root/testdata/sf0.001")
    (folder,) = set(Path(t.workspace.root.removeprefix("file:")).glob("documents-*")) - before
    for kind in ("blocks", "transactions"):
        files = list((folder / kind).glob("part-*"))
        assert files and all(file.name.endswith(".json.gz") for file in files)
