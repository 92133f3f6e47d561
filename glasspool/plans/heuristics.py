"""Attribution heuristics: miners, founders, and deposits linked to withdrawals by amount."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.functions.arrays import first_address
from glasspool.functions.money import amount
from glasspool.ledger import Ledger
from glasspool.operators.heights import with_blockhash
from glasspool.operators.joins import reshuffled
from glasspool.plans.addresses import coinbase_outputs
from glasspool.settings import FOUNDER_WITHDRAWAL, MINER_DESTINATIONS


def trivial_miners(ledger: Ledger, founders: DataFrame) -> DataFrame:
    """First addresses of coinbase outputs, without the listed founders."""
    return (
        coinbase_outputs(ledger)
        .select(first_address(F.col("vo_pubkey")).alias("address"))
        .filter(F.col("address").isNotNull())
        .distinct()
        .join(founders.select("address"), "address", "left_anti")
    )


def joinsplit_destinations(joinsplits: DataFrame, vout: DataFrame) -> DataFrame:
    """(tx_hash, address), distinct: the destination addresses of the transactions of some joinsplits.

    All joinsplits of a transaction share its destinations, so they are named once for each
    transaction, and never gathered into an array.
    """
    named = vout.select(F.col("vo_tx_hash").alias("tx_hash"), F.explode("vo_pubkey").alias("address"))
    chosen = joinsplits.select(F.col("vj_tx_hash").alias("tx_hash")).distinct()
    met = named.join(reshuffled(chosen, "tx_hash"), "tx_hash", "left_semi")
    # shuffled anew for the distinct, else the join could not split a wide transaction
    return reshuffled(met, "tx_hash").distinct()


def heuristic3_founders(
    vjoinsplit: DataFrame, vout: DataFrame, withdrawal: Decimal = FOUNDER_WITHDRAWAL
) -> DataFrame:
    """Destination addresses of joinsplits that take exactly the founder amount out."""
    exact = vjoinsplit.filter(F.col("vj_vpub_new") == amount(withdrawal))
    return joinsplit_destinations(exact, vout).select("address").distinct()


def heuristic4_destinations(
    vjoinsplit: DataFrame, vout: DataFrame, pools: DataFrame, more_than: int = MINER_DESTINATIONS
) -> DataFrame:
    """(tx_hash, address): destinations of wide joinsplits that pay a known pool.

    The pool list is joined, not listed in the plan, so it may be of any size.
    """
    named = joinsplit_destinations(vjoinsplit, vout)
    wide = (
        named.groupBy("tx_hash").agg(F.count("*").alias("width")).filter(F.col("width") > more_than)
    ).select("tx_hash")
    listed = pools.select("address").distinct()
    pays_pool = named.join(reshuffled(listed, "address"), "address", "left_semi").select("tx_hash").distinct()
    chosen = wide.join(pays_pool, "tx_hash")
    return reshuffled(named, "tx_hash").join(reshuffled(chosen, "tx_hash"), "tx_hash", "left_semi")


def heuristic4_miners(
    vjoinsplit: DataFrame, vout: DataFrame, pools: DataFrame, more_than: int = MINER_DESTINATIONS
) -> DataFrame:
    """Every destination address of joinsplits with more than `more_than`, one a known pool's."""
    return heuristic4_destinations(vjoinsplit, vout, pools, more_than).select("address").distinct()


def heuristic5_links(ledger: Ledger) -> DataFrame:
    """(amount, deposit_tx, deposit_height, withdrawal_tx, withdrawal_height).

    Amounts that occur once among deposits and once among withdrawals, where the withdrawal is in
    a later block. Each side is reduced to one row per amount, so an amount that is repeated very
    often costs one partial aggregate row per task and never meets its copies; only the pairs that
    match are placed in their blocks.
    """

    def unique(value: str, side: str) -> DataFrame:
        return (
            ledger.vjoinsplit.filter(F.col(value) > 0)
            .groupBy(F.col(value).alias("amount"))
            .agg(F.count(F.lit(1)).alias("_times"), F.min("vj_tx_hash").alias(f"{side}_tx"))
            .filter("_times = 1")
            .drop("_times")
        )

    def placed(pairs: DataFrame, side: str) -> DataFrame:
        heights = ledger.block.select(F.col("b_hash").alias("blockhash"), F.col("b_height").alias(f"{side}_height"))
        return with_blockhash(ledger, pairs, f"{side}_tx").join(heights, "blockhash").drop("blockhash")

    pairs = unique("vj_vpub_old", "deposit").join(unique("vj_vpub_new", "withdrawal"), "amount")
    return (
        placed(placed(pairs, "deposit"), "withdrawal")
        .select("amount", "deposit_tx", "deposit_height", "withdrawal_tx", "withdrawal_height")
        .filter("withdrawal_height > deposit_height")
    )


def founder_union(*lists: DataFrame) -> DataFrame:
    """Distinct addresses of several lists."""
    union = lists[0].select("address")
    for other in lists[1:]:
        union = union.unionByName(other.select("address"))
    return union.distinct()
