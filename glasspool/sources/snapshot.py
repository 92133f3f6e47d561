"""The six clean tables as Parquet, saved whole or grown by loads (see `sources.store`).

A load is refused, and leaves the store as it was, if it holds a key twice, a transaction that is stored
already, or rows of a transaction that its source does not have.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from glasspool import schema
from glasspool.ledger import Ledger
from glasspool.operators.enrichment import with_joinsplit_addresses
from glasspool.operators.inputs import resolve_inputs
from glasspool.operators.joins import reshuffled
from glasspool.sources import store
from glasspool.sources.store import table_path
from glasspool.workspace import SMALLER, Workspace


class LoadRefused(ValueError):
    """What is wrong with a load: (table, problem, rows) for each table and kind of problem."""

    def __init__(self, problems: list[tuple[str, str, int]]):
        super().__init__("; ".join(f"{table}: {rows} x {problem}" for table, problem, rows in problems))
        self.problems = problems


def _version(spark: SparkSession, path: str) -> store.Version:
    version = store.current(spark, path)
    if version is None:
        raise ValueError(f"{path} holds no ledger")
    return version


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One stored table of the current version."""
    return store.read_table(spark, path, table, _version(spark, path))


def load_ledger(spark: SparkSession, path: str) -> Ledger:
    version = _version(spark, path)
    return Ledger(**{name: store.read_table(spark, path, name, version) for name in Ledger.names()})


def _top(block: DataFrame) -> int:
    return block.agg(F.coalesce(F.max("b_height"), F.lit(0))).first()[0]


def save_ledger(ledger: Ledger, path: str) -> None:
    """Replace the snapshot at `path`, all tables at once, which may be the one the ledger is read from."""
    spark = ledger.block.sparkSession
    version = store.current(spark, path)
    load, parts = store.fresh_load(), version.parts if version else store.PARTS
    written = {
        name: store.write_load(table.select(*schema.CLEAN[name].names), path, name, load, parts)
        for name, table in ledger.tables().items()
    }
    store.commit(spark, path, store.following(version, load, _top(written["block"]), append=False))


def create_store(spark: SparkSession, path: str, parts: int = store.PARTS) -> None:
    """An empty snapshot, ready for `append_above`, its outputs and transactions stored in so many parts."""
    version = store.current(spark, path)
    store.commit(spark, path, store.Version(version.number + 1 if version else 1, {}, parts))


def stored_height(spark: SparkSession, path: str) -> int:
    """The greatest stored height, 0 for a store without blocks."""
    return _version(spark, path).height


def repeated_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) of the tables in which more than one row holds a key: the number of such keys.

    `tables` is not empty. Keys are counted only in tables that `_holds_repeated` finds.
    """
    counts = [
        rows.groupBy(*schema.KEYS[name]).count().filter("count > 1").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        for name, rows in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).filter("rows > 0")


def _holds_repeated(name: str, rows: DataFrame) -> bool:
    """Does more than one row hold a key? A key that ends in a number is met as one of 64 bits.

    So a transaction with its numbers is one row of the shuffle, not one for each number. A null number has no bit.
    """
    *first, last = schema.KEYS[name]
    if rows.schema[last].dataType.typeName() != "long" or not first:
        return not rows.groupBy(*schema.KEYS[name]).count().filter("count > 1").isEmpty()
    number = F.col(last)
    bit = F.expr(f"shiftleft(1L, CAST({last} & 63 AS INT))")
    groups = rows.groupBy(*first, F.shiftright(number, 6).alias("_word")).agg(
        F.count(F.lit(1)).alias("_rows"), F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(1)).alias("_numbers")
    )
    return not groups.filter("_rows > _numbers").isEmpty()


def save_clean(
    spark: SparkSession,
    clean: dict[str, DataFrame],
    path: str,
    genesis_tx: str | None = None,
    append: bool = False,
) -> dict[str, int]:
    """Store clean tables whose inputs are not resolved, in place of what is stored or in addition to it.

    Every table of the source is read once. Blocks and transactions are stored first and select the rows of
    their legs; rows of transactions that the source does not have are counted in the same pass, keys and
    known transactions on the written rows. A new input may spend an old output: of the stored
    outputs only the parts that the inputs name are read. Only then is the load committed, or refused.

    Returns the joinsplits counted before and after their enrichment, as observed in the two writes.
    """
    workspace = Workspace.of(spark)
    before = store.current(spark, path)
    held = before if append else None
    parts = before.parts if before else store.PARTS
    load = store.fresh_load()
    problems: list[tuple[str, str, int]] = []

    stage = partial(workspace.store, compression=SMALLER)

    def write(name: str, rows: DataFrame) -> DataFrame:
        return store.write_load(rows.select(*schema.CLEAN[name].names), path, name, load, parts)

    block = write("block", clean["block"])
    # stored without the listings, so that its size is seen and transactions are not shuffled to meet few blocks
    chosen = stage(block.select(F.col("b_hash").alias("t_blockhash"), F.lit(True).alias("_kept")).distinct())
    in_block = clean["transaction"].join(chosen, "t_blockhash", "left")
    kept = F.coalesce("_kept", F.lit(False))
    if genesis_tx is not None:
        kept &= F.col("t_tx_hash") != genesis_tx
    staged = stage(in_block.withColumn("_kept", kept))
    transaction = write("transaction", staged.filter("_kept"))
    # one row per transaction, also where the source holds it twice; four legs meet it
    known = stage(staged.groupBy("t_tx_hash").agg(F.bool_or("_kept").alias("_kept"), F.count_if("_kept").alias("_rows")))

    def legs(name: str, store_rows: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
        """The table's rows of kept transactions, stored; rows of unknown transactions are a problem.

        `store_rows` gets the rows with those that are to be counted, and what counts them and leaves them out. It
        does so in the stage that writes, so a task that is run again counts once.
        """
        key, seen = schema.TRANSACTION_KEY[name], Observation()
        met = clean[name].join(known.select(F.col("t_tx_hash").alias(key), "_kept"), key, "left")

        def counted_out(rows: DataFrame) -> DataFrame:
            observed = rows.observe(seen, F.count(F.when(F.col("_kept").isNull(), 1)).alias("orphans"))
            return observed.filter("_kept").drop("_kept")

        stored = store_rows(met.select(*clean[name].columns, "_kept"), counted_out)
        problems.append((name, "no transaction", seen.get["orphans"]))
        return stored

    def dealt(rows: DataFrame, counted_out: Callable[[DataFrame], DataFrame]) -> DataFrame:
        wanted = rows.filter(F.coalesce("_kept", F.lit(True)))
        return store.write_load(wanted.select(*schema.VOUT.names, "_kept"), path, "vout", load, parts, counted_out)

    coingen = legs("coingen", lambda rows, counted_out: write("coingen", counted_out(rows)))
    vout = legs("vout", dealt)
    inputs = legs("vin", lambda rows, counted_out: stage(counted_out(rows)))
    all_vout = vout
    if held is not None:
        named = store.parts_named(inputs, "vi_prevout_hash", parts)
        all_vout = vout.unionByName(store.read_table(spark, path, "vout", held, named))
    vin = write("vin", resolve_inputs(inputs, all_vout))
    counts = [Observation(), Observation()]
    counted = lambda rows, seen: rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    plain = legs("vjoinsplit", lambda rows, counted_out: stage(counted(counted_out(rows), counts[0])))
    write("vjoinsplit", counted(with_joinsplit_addresses(plain, vin, vout), counts[1]))
    seen = {"before": counts[0].get["rows"], "after": counts[1].get["rows"]}
    problems.append(("vjoinsplit", "changed by enrichment", abs(seen["after"] - seen["before"])))

    twice = known.filter("_rows > 1 AND t_tx_hash IS NOT NULL").count()
    problems.append(("transaction", "repeated key", twice))
    written = {"block": block, "coingen": coingen, "vin": inputs, "vout": vout}
    doubled = {name: rows for name, rows in written.items() if _holds_repeated(name, rows)}
    if doubled:
        problems += [(row["table_name"], "repeated key", row["rows"]) for row in repeated_keys(doubled).collect()]
    if held is not None:
        hashes = transaction.select("t_tx_hash").distinct()
        stored = store.read_table(spark, path, "transaction", held, store.parts_named(hashes, "t_tx_hash", parts))
        problems.append(("transaction", "stored already", hashes.join(stored, "t_tx_hash", "left_semi").count()))
    if any(rows for _, _, rows in problems):
        raise LoadRefused([problem for problem in problems if problem[2]])
    store.commit(spark, path, store.following(before, load, _top(block), append, parts))
    return seen


def append_above(spark: SparkSession, clean: dict[str, DataFrame], path: str) -> int:
    """Store the blocks above the stored height with everything in them; returns that height."""
    height = stored_height(spark, path)
    newer = {**clean, "block": clean["block"].filter(F.col("b_height") > height)}
    save_clean(spark, newer, path, append=True)
    return height


def adopt_snapshot(spark: SparkSession, source: str, path: str) -> Ledger:
    """A stored ledger from clean tables written by another tool.

    Their types are cast to the declared ones (a textual validity flag, for one), and inputs are
    resolved anew, because such snapshots do not carry the value an input spends.
    """
    clean = {}
    for name in Ledger.names():
        kind = schema.VIN if name == "vin" else schema.CLEAN[name]
        found = spark.read.parquet(table_path(source, name))
        clean[name] = found.select(
            *(F.col(field.name).cast(field.dataType).alias(field.name) for field in kind.fields)
        )
    save_clean(spark, clean, path)
    return load_ledger(spark, path)
