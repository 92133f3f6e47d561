"""Block heights: attaching them, the dense height axis, and running totals along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasspool.functions.money import to_money
from glasspool.ledger import Ledger
from glasspool.schema import MONEY_TOTAL

# Heights per slice. The axis and the running totals are worked out slice by slice, so no task
# sees more than one slice of heights plus one row per slice.
SLICE = 4096


def transaction_heights(ledger: Ledger) -> DataFrame:
    """(tx_hash, height, type) of every transaction whose block is known."""
    blocks = ledger.block.select(F.col("b_hash").alias("t_blockhash"), F.col("b_height").alias("height"))
    return ledger.transaction.join(blocks, "t_blockhash").select(
        F.col("t_tx_hash").alias("tx_hash"), "height", F.col("t_type").alias("type")
    )


def with_blockhash(ledger: Ledger, rows: DataFrame, tx: str) -> DataFrame:
    """Rows of a child table with the block hash and type of their transaction."""
    transactions = ledger.transaction.select(
        F.col("t_tx_hash").alias(tx), F.col("t_blockhash").alias("blockhash"), "t_type"
    )
    return rows.join(transactions, tx)


def height_axis(block: DataFrame, limit: int | None = None) -> DataFrame:
    """Every height from 0 to `limit`, or to the greatest stored height; empty for no blocks."""
    top = F.max("b_height") if limit is None else F.lit(limit).cast("bigint")
    slices = block.agg(top.alias("_top")).select(
        "_top",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_top") / SLICE))).alias(
            "_slice"
        ),
    )
    return slices.repartition("_slice").select(
        F.explode(
            F.sequence(
                F.col("_slice") * SLICE,
                F.least(F.col("_top"), F.col("_slice") * SLICE + (SLICE - 1)),
            )
        ).alias("height")
    )


def series_over_height(
    ledger: Ledger, rows: DataFrame, measures: dict[str, Column], limit: int | None = None
) -> DataFrame:
    """One row per height of the axis with the measures of `rows`, which carry `blockhash`.

    Rows are aggregated per block before the height is joined: blocks are few against the rows
    they hold, and map-side partial results absorb a block that holds a large share of all rows.
    Heights without rows get 0. The result is partitioned by `_slice`, as running totals want it.
    """
    per_block = rows.groupBy(F.col("blockhash").alias("b_hash")).agg(
        *(measure.alias(name) for name, measure in measures.items())
    )
    heights = ledger.block.select("b_hash", F.col("b_height").alias("height"))
    placed = per_block.join(heights, "b_hash").select("height", *measures)
    if limit is not None:
        placed = placed.filter(F.col("height") <= limit)
    kinds = {field.name: field.dataType for field in placed.schema.fields}
    empty = height_axis(ledger.block, limit).select(
        "height", *(F.lit(0).cast(kinds[name]).alias(name) for name in measures)
    )
    return sliced(placed.unionByName(empty)).groupBy("_slice", "height").agg(
        *(F.coalesce(F.sum(name), F.lit(0)).cast(kinds[name]).alias(name) for name in measures)
    )


def sliced(series: DataFrame) -> DataFrame:
    """Rows with `height`, partitioned by slice of the axis."""
    return series.withColumn("_slice", F.floor(F.col("height") / SLICE)).repartition("_slice")


def running_totals(series: DataFrame, columns: list[str]) -> DataFrame:
    """Cumulative sums over height: within each slice, plus the total of all earlier slices.

    `series` is a result of `sliced` or `series_over_height` with one row per height.
    """
    kinds = {field.name: field.dataType for field in series.schema.fields}
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        series.groupBy("_slice")
        .agg(*(F.sum(name).alias(name) for name in columns))
        .select(
            "_slice",
            *(
                F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}")
                for name in columns
            ),
        )
    )
    within = (
        Window.partitionBy("_slice")
        .orderBy("height")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inner = series.select(
        "_slice", "height", *(F.sum(name).over(within).alias(name) for name in columns)
    )

    def combined(name: str) -> Column:
        if kinds[name].typeName() == "decimal":
            both = to_money(F.col(name)) + to_money(F.col(f"_before_{name}"))
            return both.cast(MONEY_TOTAL).alias(name)
        return (F.col(name) + F.col(f"_before_{name}")).alias(name)

    return inner.join(offsets, "_slice").select("height", *(combined(name) for name in columns))
