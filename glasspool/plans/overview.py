"""Initial analysis: counts, transaction types and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.functions.arrays import parse_array_text
from glasspool.functions.classify import PUBLIC
from glasspool.functions.money import count_percent
from glasspool.ledger import Ledger


def type_counts(transaction: DataFrame) -> DataFrame:
    return transaction.groupBy("t_type").agg(F.count(F.lit(1)).alias("tx_count"))


def initial_analysis(ledger: Ledger) -> DataFrame:
    """(item, amount, percentage): block count, transaction count, and one row per type."""
    by_type = type_counts(ledger.transaction)
    total = by_type.agg(F.coalesce(F.sum("tx_count"), F.lit(0)).alias("amount"))
    blocks = ledger.block.agg(F.count(F.lit(1)).alias("amount"))
    no_share = F.lit(None).cast("decimal(18,2)").alias("percentage")
    return (
        blocks.select(F.lit("blocks").alias("item"), "amount", no_share)
        .unionByName(total.select(F.lit("transactions").alias("item"), "amount", no_share))
        .unionByName(
            by_type.select(
                F.concat(F.lit("type "), F.col("t_type")).alias("item"),
                F.col("tx_count").alias("amount"),
                count_percent(F.col("tx_count"), total.scalar()).alias("percentage"),
            )
        )
    )


def public_share(transaction: DataFrame) -> DataFrame:
    """One row: transactions, public (transparent to transparent) ones, and their share."""
    counts = transaction.agg(
        F.count(F.lit(1)).alias("tx_count"),
        F.count_if(F.col("t_type") == PUBLIC).alias("public_count"),
    )
    return counts.withColumn(
        "public_percentage", count_percent(F.col("public_count"), F.col("tx_count"))
    )


def joinsplit_array_sizes(vjoinsplit_dump: DataFrame) -> DataFrame:
    """(kind, array_size, joinsplit_count) for the text arrays of a joinsplit dump."""
    sizes = vjoinsplit_dump.select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(kind).alias("kind"),
                        F.size(parse_array_text(F.col(kind))).alias("array_size"),
                    )
                    for kind in ("nullifiers", "commitments")
                )
            )
        ).alias("entry")
    ).select("entry.*")
    return sizes.groupBy("kind", "array_size").agg(F.count(F.lit(1)).alias("joinsplit_count"))
