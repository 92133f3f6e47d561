"""The derived ledger: one order is a transaction, one order day a block, one line item an output.

The rules are in FIXTURES.md section 2. Keys that can hold a large share of all rows (a customer's
orders, an order's lines) are numbered and lagged over ranges of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glasspool.functions.classify import transaction_type
from glasspool.ledger import Ledger
from glasspool.operators.enrichment import with_joinsplit_addresses
from glasspool.operators.inputs import resolve_inputs
from glasspool.operators.positions import numbered, previous
from glasspool.plans.clusters import AddressLists
from glasspool.plans.heuristics import heuristic3_founders, heuristic4_miners, trivial_miners
from glasspool.schema import MONEY
from glasspool.workspace import Workspace

FIRST_DAY = "1995-01-01"
FIRST_DAY_SECONDS = 788918400
MINER_DESTINATIONS = 3  # the derived ledger has no transaction with more than a dozen outputs
_OUTPUT_DIGITS = (0, 1, 2, 3, 4, 6, 7)
ROWS_PER_PARTITION = 300_000  # line items behind one shuffle partition
SPLIT_BYTES = 16 << 20


def _digit() -> Column:
    return F.col("ok") % 10


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _address(wallet: Column, index: Column | str) -> Column:
    return _text("a", wallet, "_", index)


def tx_hash(order: Column) -> Column:
    return _text("t", order)


def block_hash(height: Column) -> Column:
    return _text("b", height)


@dataclass(frozen=True)
class Retail:
    """The source tables, pruned to what the derivation uses."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def orders(self) -> DataFrame:
        """(ok, ck, height, price)"""
        day = F.to_date("o_orderdate")
        return self.table("orders").select(
            F.col("o_orderkey").alias("ok"),
            F.col("o_custkey").alias("ck"),
            F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint").alias("height"),
            F.col("o_totalprice").alias("price"),
        )

    def customers(self) -> DataFrame:
        return self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")


def vout(retail: Retail) -> DataFrame:
    lines = retail.table("lineitem").select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
    ).filter(_digit().isin(*_OUTPUT_DIGITS))
    owners = retail.orders().select("ok", "ck")
    placed = numbered(
        lines, ["ok"], ["ln", "pk", "sk", "qty", "price"], "n", Workspace.of(retail.spark), beside=owners
    )
    own = _address(F.col("ck"), F.col("ln"))
    shared = _address(F.col("ck") - F.col("ck") % 4, "7")
    supplier = _text("m", F.col("sk"))
    pubkey = (
        F.when(F.col("qty") == 1, F.array().cast("array<string>"))
        .when(F.col("qty") == 50, F.array(own, supplier))
        .when(F.col("ln") == 7, F.array(shared))
        .otherwise(F.array(own))
    )
    return placed.select(
        tx_hash(F.col("ok")).alias("vo_tx_hash"),
        F.col("price").cast("decimal(18,2)").cast(MONEY).alias("vo_value"),
        F.col("n").cast("bigint").alias("vo_tx_n"),
        pubkey.alias("vo_pubkey"),
    )


def vin(retail: Retail, outputs: DataFrame) -> DataFrame:
    """Unresolved inputs: an order spends outputs of the same customer's previous order."""
    orders = retail.orders().select("ok", "ck", "height")
    linked = previous(orders, ["ck"], ["height", "ok"], "ok", "prev", Workspace.of(retail.spark))
    spends = linked.filter(_digit().between(1, 6) & F.col("prev").isNotNull()).select(
        tx_hash(F.col("ok")).alias("vi_tx_hash"), tx_hash(F.col("prev")).alias("vo_tx_hash")
    )
    return (
        outputs.filter(F.col("vo_tx_n") % 3 != 2)
        .select("vo_tx_hash", "vo_tx_n")
        .join(spends, "vo_tx_hash")
        .select(
            "vi_tx_hash",
            F.col("vo_tx_hash").alias("vi_prevout_hash"),
            F.col("vo_tx_n").alias("vi_prevout_n"),
        )
    )


def coingen(retail: Retail) -> DataFrame:
    return retail.orders().filter(_digit() == 0).select(
        tx_hash(F.col("ok")).alias("c_tx_hash"),
        _text("cb", F.col("ok")).alias("c_coinbase"),
        F.lit(4294967295).cast("bigint").alias("c_sequence"),
    )


def vjoinsplit(retail: Retail) -> DataFrame:
    """Joinsplits without addresses."""
    digit, ok, ck = _digit(), F.col("ok"), F.col("ck")
    odd = (F.floor(F.col("price") / 25).cast(MONEY) + F.lit("0.0001").cast(MONEY)).cast(MONEY)
    founder = ck % 25 == 0
    zero = F.lit(0).cast(MONEY)
    entering = (
        F.when((digit == 5) & founder, F.lit("249.9999").cast(MONEY))
        .when((digit == 5) | ((digit == 6) & (ok % 4 == 0)), odd)
        .otherwise(zero)
    )
    leaving = (
        F.when((digit == 7) & founder, F.lit("250.0001").cast(MONEY))
        .when((digit == 7) | ((digit == 6) & (ok % 4 != 0)), odd)
        .otherwise(zero)
    )
    return retail.orders().filter(digit.between(5, 8)).select(
        tx_hash(ok).alias("vj_tx_hash"),
        entering.alias("vj_vpub_old"),
        leaving.alias("vj_vpub_new"),
    )


def _seconds(height: Column) -> Column:
    return (F.lit(FIRST_DAY_SECONDS) + height * 86400).cast("int")


def transaction(retail: Retail, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    def rows_per(frame: DataFrame, tx: str, alias: str) -> DataFrame:
        return frame.groupBy(F.col(tx).alias("t_tx_hash")).agg(F.count(F.lit(1)).alias(alias))

    orders = retail.orders().select(
        tx_hash(F.col("ok")).alias("t_tx_hash"),
        block_hash(F.col("height")).alias("t_blockhash"),
        _seconds(F.col("height")).alias("t_time"),
        _digit().alias("digit"),
    )
    coinbase = F.when(F.col("digit") == 0, 1).otherwise(0)
    joinsplits = F.when(F.col("digit").between(5, 8), 1).otherwise(0)
    vin_count = F.coalesce("_vin", F.lit(0)) + coinbase
    vout_count = F.coalesce("_vout", F.lit(0))
    return (
        orders.join(rows_per(inputs, "vi_tx_hash", "_vin"), "t_tx_hash", "left")
        .join(rows_per(outputs, "vo_tx_hash", "_vout"), "t_tx_hash", "left")
        .select(
            "t_tx_hash",
            "t_blockhash",
            "t_time",
            F.col("t_time").alias("t_blocktime"),
            F.lit(True).alias("t_valid"),
            vin_count.cast("int").alias("t_tx_vin_count"),
            joinsplits.cast("int").alias("t_tx_vj_count"),
            vout_count.cast("int").alias("t_tx_vout_count"),
            transaction_type(vin_count, vout_count, joinsplits, coinbase).alias("t_type"),
        )
    )


def block(retail: Retail) -> DataFrame:
    """One block per order day, with its listing.

    A real block's size bounds its listing; here a listing has the orders of one day, a share of
    1 in 2,405 of the test tables' orders.
    """
    listing = block_listing(retail).groupBy("blockhash").agg(
        F.sort_array(F.collect_list("tx_hash")).alias("b_tx")
    )
    days = retail.orders().select("height").distinct()
    # one row per order day, a fixed calendar
    by_height = Window.orderBy("height")
    blank = F.lit("")
    return (
        days.select(
            F.col("height").alias("b_height"),
            block_hash(F.col("height")).alias("b_hash"),
            F.lit(1000).alias("b_size"),
            F.lit(4).alias("b_version"),
            _seconds(F.col("height")).alias("b_time"),
            F.coalesce(block_hash(F.lag("height").over(by_height)), blank).alias("b_previousblockhash"),
            F.coalesce(block_hash(F.lead("height").over(by_height)), blank).alias("b_nextblockhash"),
        )
        .join(listing, F.col("b_hash") == F.col("blockhash"))
        .select(
            "b_height", "b_hash", "b_size", "b_version", "b_tx", "b_time",
            "b_previousblockhash", "b_nextblockhash",
        )
    )


def block_listing(retail: Retail) -> DataFrame:
    """(tx_hash, blockhash) in long form."""
    return retail.orders().select(
        tx_hash(F.col("ok")).alias("tx_hash"), block_hash(F.col("height")).alias("blockhash")
    )


def pool_list(retail: Retail) -> DataFrame:
    return retail.customers().filter(F.col("c_mktsegment") == "MACHINERY").select(
        _address(F.col("c_custkey"), "1").alias("address"),
        _text("pool_", F.col("c_nationkey")).alias("tag"),
    )


def founder_list(retail: Retail) -> DataFrame:
    indexes = F.array(*(F.lit(str(i)) for i in range(1, 7)))
    return retail.customers().filter(F.col("c_custkey") % 25 == 0).select(
        F.col("c_custkey"), F.explode(indexes).alias("i")
    ).select(_address(F.col("c_custkey"), F.col("i")).alias("address"))


def tag_list(retail: Retail) -> DataFrame:
    return retail.customers().filter(F.col("c_mktsegment") == "HOUSEHOLD").select(
        _address(F.col("c_custkey"), "2").alias("address"),
        _text("tag_", F.col("c_nationkey")).alias("tag"),
    )


def make_room(retail: Retail) -> int:
    """Give the session's shuffles a partition for each ROWS_PER_PARTITION line items; the number it has then.

    With a fixed number the memory of a task grows with the tables, and from some size on every sort and hash
    table spills. Counts are only raised; where they are, tasks read SPLIT_BYTES at most of files or (merged again
    by adaptive execution) of a shuffle, because hash tables are many times what is read. All stay set, as the frames that queries return run later.
    """
    conf = retail.spark.conf
    held = int(conf.get("spark.sql.shuffle.partitions"))
    needed = -(-retail.table("lineitem").count() // ROWS_PER_PARTITION)
    if needed <= held:
        return held
    conf.set("spark.sql.shuffle.partitions", str(needed))
    conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SPLIT_BYTES))
    return needed


class Testbed:
    """The derived ledger of one folder, its tables written once per session and read back."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.retail = Retail(spark, folder)
        self.workspace = Workspace.of(spark)
        make_room(self.retail)
        self._prefix = "ledger-" + "".join(c if c.isalnum() else "_" for c in folder)

    def stored(self, name: str, build) -> DataFrame:
        return self.workspace.table(f"{self._prefix}/{name}", build)

    def vout(self) -> DataFrame:
        return self.stored("vout", lambda: vout(self.retail))

    def unresolved_vin(self) -> DataFrame:
        return self.stored("unresolved_vin", lambda: vin(self.retail, self.vout()))

    def vin(self) -> DataFrame:
        return self.stored("vin", lambda: resolve_inputs(vin(self.retail, self.vout()), self.vout()))

    def transaction(self) -> DataFrame:
        return self.stored(
            "transaction", lambda: transaction(self.retail, self.vin(), self.vout())
        )

    def vjoinsplit(self) -> DataFrame:
        return self.stored(
            "vjoinsplit",
            lambda: with_joinsplit_addresses(vjoinsplit(self.retail), self.vin(), self.vout()),
        )

    def block(self) -> DataFrame:
        return self.stored("block", lambda: block(self.retail))

    def ledger(self) -> Ledger:
        return Ledger(
            transaction=self.transaction(),
            block=self.block(),
            coingen=self.stored("coingen", lambda: coingen(self.retail)),
            vin=self.vin(),
            vout=self.vout(),
            vjoinsplit=self.vjoinsplit(),
        )

    def founders(self) -> DataFrame:
        return founder_list(self.retail)

    def address_lists(self) -> AddressLists:
        ledger = self.ledger()
        pools = pool_list(self.retail)
        return AddressLists(
            pools=pools,
            miners=self.stored("miners", lambda: trivial_miners(ledger, self.founders())),
            founders=self.founders(),
            heuristic_miners=self.stored(
                "miners_heuristic",
                lambda: heuristic4_miners(ledger.vjoinsplit, ledger.vout, pools, MINER_DESTINATIONS),
            ),
            heuristic_founders=self.stored(
                "founders_heuristic", lambda: heuristic3_founders(ledger.vjoinsplit, ledger.vout)
            ),
            tags=tag_list(self.retail),
        )
