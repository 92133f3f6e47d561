"""Address sets per transaction, and their attachment to joinsplits and transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspool.operators.joins import reshuffled


def _grouped_sets(vin: DataFrame, vout: DataFrame) -> DataFrame:
    """(tx_hash, sources, destinations): distinct addresses per transaction and side, sorted.

    Null means the transaction has no such leg, [] that its leg names no address. Map-side partial
    sets keep the repeated addresses of one transaction out of the shuffle.
    """

    def leg(rows: DataFrame, tx: str, addresses: str, is_source: bool) -> DataFrame:
        return rows.select(
            F.col(tx).alias("tx_hash"),
            F.lit(is_source).alias("is_source"),
            F.explode_outer(addresses).alias("address"),
        )

    is_source, address = F.col("is_source"), F.col("address")

    def gathered(condition: Column) -> Column:
        return F.when(
            F.bool_or(condition), F.sort_array(F.collect_set(F.when(condition, address)))
        )

    return (
        leg(vin, "vi_tx_hash", "vi_address", True)
        .unionByName(leg(vout, "vo_tx_hash", "vo_pubkey", False))
        .groupBy("tx_hash")
        .agg(
            gathered(is_source).alias("sources"),
            gathered(~is_source).alias("destinations"),
        )
    )


def address_sets(vin: DataFrame, vout: DataFrame) -> DataFrame:
    """The sets of every transaction, to be joined by `tx_hash`."""
    return _grouped_sets(vin, vout).transform(reshuffled, "tx_hash")


def with_joinsplit_addresses(
    vjoinsplit: DataFrame, vin: DataFrame, vout: DataFrame
) -> DataFrame:
    """Replace both address columns by the transaction's input and output address sets.

    The row count does not change: a transaction has one row of sets at most. Sets of transactions
    without joinsplits are left out where they are gathered, so only the others are shuffled anew.
    """
    named = vjoinsplit.select(F.col("vj_tx_hash").alias("tx_hash")).distinct()
    sets = _grouped_sets(vin, vout).join(named, "tx_hash", "left_semi").transform(reshuffled, "tx_hash")
    return (
        vjoinsplit.select(F.col("vj_tx_hash").alias("tx_hash"), "vj_vpub_old", "vj_vpub_new")
        .join(sets, "tx_hash", "left")
        .select(
            F.col("tx_hash").alias("vj_tx_hash"),
            "vj_vpub_old",
            "vj_vpub_new",
            F.col("sources").alias("vj_source_address"),
            F.col("destinations").alias("vj_dest_address"),
        )
    )


def transaction_address_sets(
    transaction: DataFrame, vin: DataFrame, vout: DataFrame
) -> DataFrame:
    """Every transaction with its destination and source address sets (null = no such leg)."""
    return (
        transaction.select(
            F.col("t_tx_hash").alias("tx_hash"), F.col("t_blockhash").alias("blockhash")
        )
        .join(address_sets(vin, vout), "tx_hash", "left")
        .select(
            "tx_hash",
            "blockhash",
            F.col("destinations").alias("dest_addresses"),
            F.col("sources").alias("src_addresses"),
        )
    )
