import shutil
import json
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from glasspool import Ledger, Workspace, schema
from glasspool.operators.normalize import normalize
from glasspool.sources import store  # noqa: E402
from glasspool.sources import address_lists, delimited, node_json, snapshot
from glasspool.streaming import ingest, resolve
from glasspool.workspace import shared_folder
from tests.conftest import money, rows

BLOCKS = [
    {"height": 1, "hash": "b1", "size": 9, "version": 4, "tx": ["t1"], "time": 10, "nextblockhash": "b2"},
    {"height": 2, "hash": "b2", "size": 9, "version": 4, "tx": ["t2", "t3", "lost"], "time": 20,
     "previousblockhash": "b1"},
]
SHIELDED = {"vpub_old": 1.25, "vpub_new": 0.0}
TRANSACTIONS = [
    {"txid": "t1", "blockhash": "b1", "time": 10, "blocktime": 10,
     "vin": [{"coinbase": "cb", "sequence": 1}],
     "vout": [
         {"value": 10.0, "n": 0, "scriptPubKey": {"addresses": ["a", "a"]}},
         {"value": 2.5, "n": 1, "scriptPubKey": {}},
     ],
     "vjoinsplit": []},
    {"txid": "t2", "blockhash": "b2", "time": 20, "blocktime": 20,
     "vin": [{"txid": "t1", "vout": 0, "sequence": 1}], "vout": [],
     "vjoinsplit": [SHIELDED, SHIELDED]},
    {"txid": "t3", "blockhash": "b2", "time": 20, "blocktime": 20,
     "vin": [], "vout": [{"value": 0.5, "n": 0, "scriptPubKey": {"addresses": ["c"]}}],
     "vjoinsplit": [{"vpub_old": 0.0, "vpub_new": 0.5}]},
]


def write_documents(folder: Path, name: str, documents) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(d) for d in documents))
    return str(folder)


@pytest.fixture
def documents(tmp_path):
    return (
        write_documents(tmp_path / "blocks", "part.json", BLOCKS),
        write_documents(tmp_path / "transactions", "part.json", TRANSACTIONS),
    )


def test_documents_to_ledger(spark, documents):
    ledger = node_json.load_documents(spark, *documents)
    found = {row["t_tx_hash"]: row for row in ledger.transaction.collect()}
    assert {name: row["t_type"] for name, row in found.items()} == {
        "t1": "minerReward",
        "t2": "shielded",
        "t3": "deshielded",
        "lost": "UNKNOWN",
    }
    assert found["lost"]["t_valid"] is False and found["lost"]["t_blockhash"] == "b2"
    assert (found["t2"]["t_tx_vin_count"], found["t2"]["t_tx_vj_count"]) == (1, 2)
    assert rows(ledger.vin) == [("t2", "t1", 0, ["a"], money("10.00000000"))]
    assert rows(ledger.vout.select("vo_tx_hash", "vo_tx_n", "vo_pubkey", "vo_value")) == [
        ("t1", 0, ["a"], money("10.00000000")),
        ("t1", 1, [], money("2.50000000")),
        ("t3", 0, ["c"], money("0.50000000")),
    ]
    assert rows(ledger.coingen) == [("t1", "cb", 1)]
    joinsplits = rows(ledger.vjoinsplit)
    assert joinsplits[0] == joinsplits[1] == ("t2", money("1.25000000"), money("0E-8"), ["a"], None)
    assert joinsplits[2][3:] == (None, ["c"])
    ends = ledger.block.orderBy("b_height").collect()
    assert (ends[0]["b_previousblockhash"], ends[1]["b_nextblockhash"]) == ("", "")
    assert ends[1]["b_tx"] == ["t2", "t3", "lost"]


def test_raw_destinations_before_enrichment(spark, documents):
    legs = node_json.flatten_legs(node_json.read_transactions(spark, documents[1]))
    found = rows(legs["vjoinsplit"].select("vj_tx_hash", "vj_dest_address"))
    assert found == [("t2", []), ("t2", []), ("t3", ["c"])]


def test_snapshot_round_trip(spark, documents, tmp_path):
    ledger = node_json.load_documents(spark, *documents)
    path = str(tmp_path / "snapshot")
    snapshot.save_ledger(ledger, path)
    again = snapshot.load_ledger(spark, path)
    for name, table in ledger.tables().items():
        assert rows(again.tables()[name]) == rows(table)
    assert snapshot.stored_height(spark, path) == 2


def test_foreign_snapshots_are_adopted(spark, documents, tmp_path):
    ledger = node_json.load_documents(spark, *documents)
    source = str(tmp_path / "foreign")
    for name, table in ledger.tables().items():
        table.write.parquet(snapshot.table_path(source, name))
    ledger.transaction.withColumn(
        "t_valid", ledger.transaction["t_valid"].cast("string")
    ).write.mode("overwrite").parquet(snapshot.table_path(source, "transaction"))
    ledger.vin.drop("vi_value").write.mode("overwrite").parquet(
        snapshot.table_path(source, "vin")
    )
    adopted = snapshot.adopt_snapshot(spark, source, str(tmp_path / "own"))
    for name, table in ledger.tables().items():
        assert rows(adopted.tables()[name]) == rows(table), name


def test_incremental_loads_resume_and_repeat(spark, documents, tmp_path):
    path = str(tmp_path / "store")
    snapshot.create_store(spark, path)
    assert snapshot.stored_height(spark, path) == 0
    clean = node_json.flatten(
        node_json.read_blocks(spark, documents[0]), node_json.read_transactions(spark, documents[1])
    )
    first = {**clean, "block": clean["block"].filter("b_height <= 1")}
    assert snapshot.append_above(spark, first, path) == 0
    # a second load that dies before it is committed leaves the store as it was
    partial = clean["vout"].filter("vo_tx_hash = 't3'")
    store.write_load(partial, path, "vout", "dead", store.current(spark, path).parts)
    assert snapshot.stored_height(spark, path) == 1
    assert "t3" not in {r[0] for r in snapshot.read_table(spark, path, "vout").select("vo_tx_hash").collect()}
    assert snapshot.append_above(spark, clean, path) == 1
    assert snapshot.append_above(spark, clean, path) == 2
    stored = snapshot.load_ledger(spark, path)
    whole = node_json.load_documents(spark, *documents)
    for name, table in whole.tables().items():
        assert rows(stored.tables()[name]) == rows(table), name


def test_stream_appends_once(spark, tmp_path):
    source, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    write_documents(Path(source), "one.json", TRANSACTIONS[:1])
    ingest.start_ingest(spark, source, store, progress).awaitTermination()
    # the second file repeats a stored transaction
    write_documents(Path(source), "two.json", TRANSACTIONS)
    write_documents(Path(source), "three.json", TRANSACTIONS[1:])
    ingest.start_ingest(spark, source, store, progress, files_per_batch=1).awaitTermination()
    legs = ingest.resolved_legs(spark, store)
    assert rows(legs["transaction"].select("t_tx_hash")) == [("t1",), ("t2",), ("t3",)]
    assert legs["vout"].count() == 3
    assert rows(legs["vin"]) == [("t2", "t1", 0, ["a"], money("10.00000000"))]
    assert legs["vjoinsplit"].count() == 3
    # a batch that is run again replaces what it wrote
    last = ingest.stored(spark, store, "transaction").orderBy("batch", ascending=False).first()
    ingest.append_batch(node_json.read_transactions(spark, source), last["batch"], store, last["ingest"])
    assert ingest.stored(spark, store, "transaction").count() == 3
    # another checkpoint over the same store adds what is new and replaces nothing
    other = str(tmp_path / "other")
    write_documents(Path(other), "four.json", [TRANSACTIONS[0], {**TRANSACTIONS[0], "txid": "t9"}])
    ingest.start_ingest(spark, other, store, str(tmp_path / "progress2")).awaitTermination()
    found = ingest.stored(spark, store, "transaction").select("t_tx_hash")
    assert rows(found) == [("t1",), ("t2",), ("t3",), ("t9",)]
    # a lost checkpoint is refused, a broken document stops the ingest
    shutil.rmtree(progress)
    with pytest.raises(ValueError):
        ingest.start_ingest(spark, source, store, progress)
    (Path(other) / "five.json").write_text('{"txid": "t10", "vin": [\n')
    with pytest.raises(Exception):
        ingest.start_ingest(spark, other, store, str(tmp_path / "progress2")).awaitTermination()
    assert rows(ingest.stored(spark, store, "transaction").select("t_tx_hash")) == rows(found)


def test_stream_knows_its_documents_without_reading_the_store(spark, tmp_path, monkeypatch):
    source, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    write_documents(Path(source), "one.json", TRANSACTIONS[:2])
    ingest.start_ingest(spark, source, store, progress).awaitTermination()
    own = ingest.stored(spark, store, "transaction").filter("batch >= 0").first()["ingest"]
    # of the own ingest no folder is read
    others = ingest._others(spark, store, "transaction", "t_tx_hash", 1, own, True)
    assert "PartitionFilters: [isnotnull(ingest" in others._jdf.queryExecution().toString() and others.isEmpty()
    assert ingest._others(spark, store, "transaction", "t_tx_hash", 1, own, False).count() == 2
    # nothing stored is there to compare with, and repeated documents are still dropped, over batches and runs
    nothing = spark.createDataFrame([], "_key string")
    monkeypatch.setattr(ingest, "_others", lambda *_: nothing)
    write_documents(Path(source), "two.json", [*TRANSACTIONS[:2], TRANSACTIONS[2], TRANSACTIONS[2]])
    write_documents(Path(source), "three.json", TRANSACTIONS)
    ingest.start_ingest(spark, source, store, progress, files_per_batch=1).awaitTermination()
    assert rows(ingest.stored(spark, store, "transaction").select("t_tx_hash")) == [("t1",), ("t2",), ("t3",)]
    assert ingest.stored(spark, store, "vout").count() == 3
    # a document that cannot be used is not hidden by a good one with its id, and stops each attempt
    broken = {**TRANSACTIONS[0], "vout": [{"n": 0}]}
    write_documents(Path(source), "four.json", [broken])
    for _ in range(2):
        with pytest.raises(Exception, match="cannot be used"):
            ingest.start_ingest(spark, source, store, progress).awaitTermination()
    assert ingest.stored(spark, store, "transaction").count() == 3


def test_blocks_and_transactions_stream_into_one_store(spark, documents, tmp_path):
    store = str(tmp_path / "both")
    ingest.start_block_ingest(spark, documents[0], store, str(tmp_path / "pb")).awaitTermination()
    ingest.start_ingest(spark, documents[1], store, str(tmp_path / "pt")).awaitTermination()
    legs, whole = ingest.resolved_legs(spark, store), node_json.load_documents(spark, *documents)
    for name, table in whole.tables().items():
        assert rows(legs[name]) == rows(table.select(*legs[name].columns)), name


def test_broken_documents_are_refused_or_set_aside(spark, documents, tmp_path, workspace):
    blocks, source = documents[0], tmp_path / "mixed"
    write_documents(source, "good.json", TRANSACTIONS[:2])
    text = json.dumps({**TRANSACTIONS[0], "txid": "bad", "vout": [{"n": 0, "value": "much", "scriptPubKey": {}}]})
    (source / "bad.json").write_text(text + "\n" + json.dumps(TRANSACTIONS[2])[:-20] + "\n{}\n")
    with pytest.raises(ValueError):
        node_json.import_documents(spark, blocks, str(source), str(tmp_path / "a"), workspace)
    with pytest.raises(Exception):
        node_json.read_transactions(spark, str(source)).collect()
    ledger = node_json.import_documents(spark, blocks, str(source), str(tmp_path / "b"), workspace, str(tmp_path / "rejects"))
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 3
    valid = ledger.transaction.filter("t_valid")
    assert rows(valid.select("t_tx_hash")) == [("t1",), ("t2",)]


def dump(folder: Path, table: str, header: str, *lines: str) -> None:
    (folder / delimited.DUMP_FILES[table]).write_text("\n".join((header, *lines)) + "\n")


def write_small_dumps(folder: Path) -> None:
    dump(folder, "block",
         "height;hash;size;version;merkleroot;tx;time;nonce;difficulty;chainwork;anchor;previousblockhash;nextblockhash",
         '0;b0;1;4;m;{g};5;n;1;c;a;"";b1', "1;b1;1;4;m;{t1,t2};6;n;1.5;c;a;b0;b2", '2;b2;1;4;m;{t3};7;n;1;c;a;b1;""')
    dump(folder, "transaction",
         "tx_hash;version;locktime;blockhash;time;blocktime;valid;tx_vin_count;tx_vj_count;tx_vout_count;type",
         "g;1;0;b0;5;5;t;1;0;1;minerReward", "t1;1;0;b1;6;6;t;1;0;1;minerReward",
         "t2;1;0;b1;6;6;t;1;1;1;mixed", "t3;1;0;b2;7;7;f;0;0;0;UNKNOWN")
    dump(folder, "coingen", "db_id;tx_hash;coinbase;sequence", "1;g;x;1", "2;t1;y;1")
    dump(folder, "vin", "db_id;tx_hash;prevout_hash;prevout_n;sequence;address", "1;t2;t1;0;1;{}")
    dump(folder, "vout", "db_id;tx_hash;value;valueZat;tx_n;pubkey;isVjoinsplit",
         "1;g;1;1;0;{z};f", "2;t1;10.123456785;1;0;{a};f", "3;t2;3;1;0;{b, c};f")
    dump(folder, "vjoinsplit",
         "db_id;tx_hash;vpub_old;vpub_new;anchor;nullifiers;commitments;onetimePubKey;randomSeed;macs;source_address;dest_address",
         "1;t2;7.5;0;a;{n1,n2};{c1};k;s;{};{};{}")


def test_dumps_to_ledger(spark, tmp_path):
    write_small_dumps(tmp_path)
    ledger = delimited.load_dumps(spark, str(tmp_path), height_limit=1, genesis_tx="g")
    assert rows(ledger.transaction.select("t_tx_hash", "t_valid")) == [("t1", True), ("t2", True)]
    assert rows(ledger.block.select("b_height", "b_tx", "b_previousblockhash")) == [
        (0, ["g"], ""),
        (1, ["t1", "t2"], "b0"),
    ]
    assert rows(ledger.vin) == [("t2", "t1", 0, ["a"], money("10.12345679"))]
    assert rows(ledger.vout.select("vo_tx_hash", "vo_pubkey")) == [("t1", ["a"]), ("t2", ["b", "c"])]
    assert rows(ledger.vjoinsplit) == [
        ("t2", money("7.50000000"), money("0E-8"), ["a"], ["b", "c"])
    ]
    assert [field.dataType for field in ledger.vout.schema] == [
        field.dataType for field in schema.VOUT
    ]


def test_lazy_and_stored_imports_agree(spark, documents, workspace, tmp_path):
    write_small_dumps(tmp_path)
    lazy = delimited.load_dumps(spark, str(tmp_path), 1, "g")
    stored = delimited.import_dumps(spark, str(tmp_path), str(tmp_path / "store"), 1, "g")
    for name, table in lazy.tables().items():
        assert rows(stored.tables()[name]) == rows(table), name
    lazy = node_json.load_documents(spark, *documents)
    stored = node_json.import_documents(spark, *documents, str(tmp_path / "nested"), workspace)
    for name, table in lazy.tables().items():
        assert rows(stored.tables()[name]) == rows(table), name


def test_a_value_of_the_wrong_type_stops_the_load(spark, tmp_path):
    dump(tmp_path, "coingen", "db_id;tx_hash;coinbase;sequence", "1;g;x;many")
    frame = delimited.read_dump(
        spark, str(tmp_path / delimited.DUMP_FILES["coingen"]), "coingen"
    )
    with pytest.raises(Exception, match="MALFORMED"):
        frame.collect()


def test_relational_staging_shape_is_accepted(spark):
    staged = {name: spark.createDataFrame([], kind) for name, kind in schema.STAGING.items()}
    ledger = normalize(staged, 5)
    for name in Ledger.names():
        assert ledger.tables()[name].columns == schema.CLEAN[name].names


def write_list(path: Path, *lines: str) -> str:
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_address_lists(spark, tmp_path):
    one = write_list(tmp_path / "one.csv", "address", "b", "a", "b", "c;note")
    assert rows(address_lists.read_address_list(spark, one)) == [("a",), ("b",), ("c",)]
    assert rows(address_lists.duplicated_addresses(spark, one)) == [("b", 2)]
    two = write_list(tmp_path / "two.csv", "address;tag", "a;x", "a;y", "short", "b;z", "c;", ";t", "d;t;u")
    assert rows(address_lists.read_address_list(spark, two)) == [("a", "y"), ("b", "z"), ("c", "")]
    three = write_list(tmp_path / "three.csv", "address;tag;more", "a;b;c")
    with pytest.raises(ValueError):
        address_lists.read_address_list(spark, three)
    with pytest.raises(Exception):
        address_lists.read_address_list(spark, str(tmp_path / "absent.csv"))


def test_all_six_lists(spark, tmp_path):
    for name, file in address_lists.LIST_FILES.items():
        header = "address;tag" if name in ("pools", "tags") else "address"
        write_list(tmp_path / file, header, "a;t" if ";" in header else "a")
    lists = address_lists.read_address_lists(spark, str(tmp_path))
    assert set(lists) == set(address_lists.LIST_FILES)
    write_list(tmp_path / "pool_addresses.csv", "address", "a")
    with pytest.raises(ValueError):
        address_lists.read_address_lists(spark, str(tmp_path))


def test_result_files(spark, build, tmp_path):
    table = spark.createDataFrame(
        [("", Decimal("1.5"), ["x", "y"]), ("a", None, [])],
        "address string, v decimal(38,8), names array<string>",
    )
    path = str(tmp_path / "result")
    delimited.write_csv(table, path)
    kind = schema.StructType(
        [table.schema["address"], table.schema["v"], schema.StructField("names", schema.StringType())]
    )
    assert rows(delimited.read_csv(spark, path, kind)) == [
        ("", Decimal("1.50000000"), "x,y"),
        ("a", None, ""),
    ]
    addresses = str(tmp_path / "addresses")
    delimited.write_address_list(build.addresses("q"), addresses)
    assert rows(address_lists.read_address_list(spark, addresses)) == [("q",)]


def test_rich_list_file_is_in_order(spark, tmp_path):
    top = spark.createDataFrame(
        [("b", Decimal(1)), ("a", Decimal(2))], "address string, recv decimal(38,8)"
    )
    path = tmp_path / "rich"
    delimited.write_rich_list(top, str(path), "Total Coins received")
    (file,) = path.glob("part-*")
    assert file.read_text().split() == ["Address;Total", "Coins", "received", "a;2.00000000", "b;1.00000000"]


class ClusterSession:
    """Settings of a session on a cluster master."""

    def __init__(self, **settings):
        self.settings = settings
        self.conf = self

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_workspace_uses_the_shared_folder():
    on_cluster = ClusterSession(**{"spark.master": "spark://host:7077"})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(on_cluster)
    on_cluster.settings["spark.checkpoint.dir"] = "hdfs://shared/checkpoints/"
    assert shared_folder(on_cluster) == "hdfs://shared/checkpoints"
    assert Workspace(on_cluster).root.startswith("hdfs://shared/checkpoints/glasspool-")


def test_a_broken_save_leaves_the_old_snapshot_whole(spark, documents, tmp_path, monkeypatch):
    path = str(tmp_path / "versions")
    old = node_json.load_documents(spark, *documents)
    snapshot.save_ledger(old, path)
    newer = Ledger.empty(spark)
    written = []

    def breaking(rows, folder, table, load, parts, write=store.write_load):
        if len(written) == 3:
            raise OSError("the disk is full")
        written.append(table)
        return write(rows, folder, table, load, parts)

    monkeypatch.setattr(store, "write_load", breaking)
    with pytest.raises(OSError):
        snapshot.save_ledger(newer, path)
    monkeypatch.undo()
    assert len(written) == 3
    again = snapshot.load_ledger(spark, path)
    for name, table in old.tables().items():
        assert rows(again.tables()[name]) == rows(table), name
    # what the broken save left is no part of the store, and is cleared away
    assert len(store.vacuum(spark, path)) == 1
    assert rows(snapshot.read_table(spark, path, "vout")) == rows(old.vout)
    # a ledger may replace the snapshot that it is read from
    snapshot.save_ledger(again.with_tables(coingen=newer.coingen), path)
    last = snapshot.load_ledger(spark, path)
    assert last.coingen.count() == 0 and rows(last.vout) == rows(old.vout)
    assert store.current(spark, path).number == 2


def clean_tables(build, height, *transactions):
    """One block with transactions (hash, previous hash or None): each has one output and spends one."""
    block = f"b{height}"
    return {
        "block": build.blocks(**{block: height}),
        "transaction": build.transactions(*((tx, block, "public") for tx, _ in transactions)),
        "coingen": build.coingen(),
        "vin": build.frame(schema.VIN, [(tx, prev, 0) for tx, prev in transactions if prev]),
        "vout": build.vout(*((tx, 0, [f"a-{tx}"], 1) for tx, _ in transactions)),
        "vjoinsplit": build.joinsplits((transactions[0][0], 0, 1, None, None)),
    }


def test_a_load_reads_only_the_parts_that_its_inputs_name(spark, build, tmp_path, monkeypatch):
    path = str(tmp_path / "parts")
    snapshot.create_store(spark, path, parts=16)
    first = [(f"t{i}", None) for i in range(200)]
    snapshot.append_above(spark, clean_tables(build, 1, *first), path)
    read, plans = store.read_table, []

    def watched(session, folder, table, version, parts=None):
        found = read(session, folder, table, version, parts)
        if parts is not None:
            plans.append((table, parts, plan_of(found)))
        return found

    monkeypatch.setattr(store, "read_table", watched)
    second = [("u1", "t7"), ("u2", "t8"), ("u3", "nothing")]
    assert snapshot.append_above(spark, clean_tables(build, 2, *second), path) == 1
    assert {table for table, _, _ in plans} == {"vout", "transaction"}
    for _, parts, plan in plans:
        # the scan lists the folders of these parts and no other
        assert 1 <= len(parts) <= 3
        listed = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert all(f"#" in listed and str(part) in listed for part in parts) and listed.startswith("part#")
    assert rows(snapshot.read_table(spark, path, "vin").select("vi_tx_hash", "vi_address")) == [("u1", ["a-t7"]), ("u2", ["a-t8"])]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def refused(spark, path, clean):
    before = {name: rows(table) for name, table in snapshot.load_ledger(spark, path).tables().items()}
    version = store.current(spark, path)
    with pytest.raises(snapshot.LoadRefused) as caught:
        snapshot.append_above(spark, clean, path)
    assert store.current(spark, path) == version
    for name, table in snapshot.load_ledger(spark, path).tables().items():
        assert rows(table) == before[name]
    return sorted(caught.value.problems)


def test_bad_loads_are_refused_and_leave_the_store(spark, build, tmp_path):
    path = str(tmp_path / "gates")
    snapshot.create_store(spark, path, parts=4)
    snapshot.append_above(spark, clean_tables(build, 1, ("t1", None), ("t2", None)), path)
    good = clean_tables(build, 2, ("u1", "t1"), ("u2", "t2"))
    twice = {**good, "vout": good["vout"].union(good["vout"].filter("vo_tx_hash = 'u2'"))}
    assert refused(spark, path, twice) == [("vout", "repeated key", 1)]
    twice = {**good, "transaction": good["transaction"].union(good["transaction"]), "vin": good["vin"].union(good["vin"])}
    assert refused(spark, path, twice) == [("transaction", "repeated key", 2), ("vin", "repeated key", 2)]
    lost = {**good, "transaction": good["transaction"].filter("t_tx_hash <> 'u1'")}
    assert refused(spark, path, lost) == [("vin", "no transaction", 1), ("vjoinsplit", "no transaction", 1), ("vout", "no transaction", 1)]
    nameless = {**good, "vout": build.vout(("u1", 0, ["a"], 1), ("u2", 0, ["a"], 1), (None, 0, ["a"], 1))}
    assert refused(spark, path, nameless) == [("vout", "no transaction", 1)]
    again = clean_tables(build, 2, ("t2", None), ("u2", "t1"))
    assert refused(spark, path, again) == [("transaction", "stored already", 1)]
    assert snapshot.append_above(spark, good, path) == 1
    assert snapshot.stored_height(spark, path) == 2
    assert rows(snapshot.read_table(spark, path, "vin").select("vi_tx_hash", "vi_address")) == [("u1", ["a-t1"]), ("u2", ["a-t2"])]


def test_two_writers_of_one_version_do_not_both_win(spark, build, tmp_path):
    path = str(tmp_path / "race")
    snapshot.create_store(spark, path)
    version = store.current(spark, path)
    store.commit(spark, path, store.following(version, "one", 1, append=True))
    with pytest.raises(Exception):
        store.commit(spark, path, store.following(version, "two", 1, append=True))
    assert store.current(spark, path).loads == {"one": 1}


def test_enrichment_keeps_the_number_of_joinsplits(spark, build, tmp_path):
    seen = snapshot.save_clean(spark, clean_tables(build, 1, ("t1", None), ("t2", None)), str(tmp_path / "counted"))
    assert seen == {"before": 1, "after": 1}


def test_inputs_are_resolved_as_documents_come(spark, tmp_path):
    """Also across restarts, for outputs that come after the inputs that spend them, and once only."""
    source, path, progress = (str(tmp_path / n) for n in ("in", "resolved", "progress"))

    def document(tx, spends=(), outputs=1):
        return {
            "txid": tx,
            "vin": [{"txid": prev, "vout": n} for prev, n in spends] or [{"coinbase": "cb"}],
            "vout": [{"n": n, "value": 0.1 + n, "scriptPubKey": {"addresses": [f"{tx}-{n}"]} if n else {}} for n in range(outputs)],
        }

    def run(*documents):
        for one in documents:
            write_documents(Path(source), f"{one['txid']}-{len(list(Path(source).glob('*')))if Path(source).exists() else 0}.json", [one])
        resolve.start_resolving(spark, source, path, progress, files_per_batch=1).awaitTermination()
        return rows(resolve.resolved_inputs(spark, path))

    amounts = [money("0.10000000"), money("1.10000000")]
    assert run(document("late-spender", [("late", 1), ("never", 0)])) == []
    first = [("s1", "t1", 0, [], amounts[0])]
    assert run(document("t1", outputs=2), document("s1", [("t1", 0)])) == first
    # nothing new, a repeated document, and an output that releases the input that waited for it
    assert run() == first
    second = sorted([*first, ("late-spender", "late", 1, ["late-1"], amounts[1])], key=repr)
    assert run(document("s1", [("t1", 0)]), document("late", outputs=2)) == second
    third = sorted([*second, ("s2", "t1", 1, ["t1-1"], amounts[1])], key=repr)
    assert run(document("s2", [("t1", 1), ("t1", 0)])) == third
    (Path(source) / "broken.json").write_text('{"vin": []}')
    with pytest.raises(Exception):
        run()
    assert rows(resolve.resolved_inputs(spark, path)) == third


def test_transactions_of_one_bucket_are_resolved_in_one_call(spark, tmp_path):
    """A group of the stream is a bucket of transactions; each keeps outputs and waiting inputs of its own."""
    source, path, progress = (str(tmp_path / n) for n in ("in", "resolved", "progress"))

    def run(name, *documents):
        write_documents(Path(source), name, documents)
        resolve.start_resolving(spark, source, path, progress, buckets=1).awaitTermination()
        return rows(resolve.resolved_inputs(spark, path).select("vi_tx_hash", "vi_prevout_hash", "vi_address"))

    def document(tx, *spends):
        return {
            "txid": tx,
            "vin": [{"txid": prev, "vout": 0} for prev in spends] or [{"coinbase": "cb"}],
            "vout": [{"n": 0, "value": 1.5, "scriptPubKey": {"addresses": [f"of-{tx}"]}}],
        }

    assert run("1.json", document("a"), document("b"), document("s", "a", "late", "b")) == [
        ("s", "a", ["of-a"]), ("s", "b", ["of-b"])
    ]
    again = run("2.json", document("late"), document("z", "late"), document("thief", "a", "s"))
    assert again == [("s", "a", ["of-a"]), ("s", "b", ["of-b"]), ("s", "late", ["of-late"]), ("thief", "s", ["of-s"])]
    held = spark.read.format("statestore").option("stateVarName", "held").option("operatorId", 0).load(progress)
    kept = {row["source"]: (row["unspent"], row["waiting"]) for row in held.select("user_map_key.*", "user_map_value.*").collect()}
    assert kept.keys() == {"a", "late", "z", "thief"}
    assert kept["a"] == (None, '[[0, "thief"]]') and kept["late"] == (None, '[[0, "z"]]')
    assert json.loads(kept["z"][0]) == [{"n": 0, "addresses": ["of-z"], "value": "1.50000000"}] and kept["z"][1] is None
