"""Reports of broken keys, orphan rows, missing transactions and inconsistent joinsplits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool import schema
from glasspool.functions.classify import UNKNOWN
from glasspool.ledger import Ledger


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def key_violations(ledger: Ledger) -> DataFrame:
    """(table_name, key, row_count) for every natural key held by more than one row."""
    return _union(
        [
            ledger.tables()[name]
            .groupBy(*key)
            .agg(F.count(F.lit(1)).alias("row_count"))
            .filter("row_count > 1")
            .select(
                F.lit(name).alias("table_name"),
                F.concat_ws("/", *(F.col(column).cast("string") for column in key)).alias("key"),
                "row_count",
            )
            for name, key in schema.KEYS.items()
        ]
    )


def orphan_rows(ledger: Ledger) -> DataFrame:
    """(table_name, tx_hash, row_count) of child rows whose transaction is not stored."""
    known = ledger.transaction.select(F.col("t_tx_hash").alias("tx_hash"))
    return _union(
        [
            ledger.tables()[name]
            .groupBy(F.col(key).alias("tx_hash"))
            .agg(F.count(F.lit(1)).alias("row_count"))
            .join(known, "tx_hash", "left_anti")
            .select(F.lit(name).alias("table_name"), "tx_hash", "row_count")
            for name, key in schema.TRANSACTION_KEY.items()
        ]
    )


def block_listing(block: DataFrame) -> DataFrame:
    """(tx_hash, blockhash): the transactions each block names."""
    return block.select(F.explode("b_tx").alias("tx_hash"), F.col("b_hash").alias("blockhash"))


def missing_transactions(listing: DataFrame, transaction: DataFrame) -> DataFrame:
    """A clean transaction row, not valid and without legs, per listed but unknown transaction."""
    absent = listing.join(
        transaction.select(F.col("t_tx_hash").alias("tx_hash")), "tx_hash", "left_anti"
    )
    zero = F.lit(0)
    return absent.select(
        F.col("tx_hash").alias("t_tx_hash"),
        F.col("blockhash").alias("t_blockhash"),
        zero.alias("t_time"),
        zero.alias("t_blocktime"),
        F.lit(False).alias("t_valid"),
        zero.alias("t_tx_vin_count"),
        zero.alias("t_tx_vj_count"),
        zero.alias("t_tx_vout_count"),
        F.lit(UNKNOWN).alias("t_type"),
    )


def ambiguous_members(clusters: DataFrame) -> DataFrame:
    """Addresses in more than one cluster; empty when the clusters are disjoint."""
    return (
        clusters.groupBy("address")
        .agg(
            F.min("cluster_id").alias("first_cluster"), F.max("cluster_id").alias("last_cluster")
        )
        .filter("first_cluster <> last_cluster")
    )
