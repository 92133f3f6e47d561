"""Numbering rows without sending a large group, or everything, to one task.

Keys of at most LARGE_KEY rows are numbered by a window, after the one shuffle that this takes; only the rows of
larger keys, if there are any, are dealt out by ranges, written and shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasspool.workspace import SMALLER, Workspace

_ROWS_PER_PARTITION_BITS = 33  # fixed by monotonically_increasing_id
LARGE_KEY = 1_000_000  # rows


def _placed(df: DataFrame, order: list[Column | str], workspace: Workspace) -> DataFrame:
    """`df` in ranges of `order`, with the range of each row (_part) and its place there (_place).

    The sorted rows are written, because range bounds are sampled and must not be drawn twice.
    """
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return workspace.store(
        numbered.select(
            *df.columns,
            F.shiftright("_id", _ROWS_PER_PARTITION_BITS).alias("_part"),
            F.col("_id").bitwiseAND((1 << _ROWS_PER_PARTITION_BITS) - 1).alias("_place"),
        ),
        compression=SMALLER,
    )


def _by_size(df: DataFrame, key: list[str], workspace: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys of at most LARGE_KEY rows, and those of larger keys or None; rows without a key are in neither."""
    keyed = df.dropna(subset=key)
    sizes = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    large = workspace.store(sizes.filter(F.col("_rows") > LARGE_KEY).select(*key))
    if large.isEmpty():
        return keyed, None
    return keyed.join(large, key, "left_anti").select(df.columns), keyed.join(large, key, "left_semi").select(df.columns)


def numbered(
    df: DataFrame, key: list[str], order: list[str], alias: str, workspace: Workspace, beside: DataFrame | None = None
) -> DataFrame:
    """row_number() over (partition by key order by order) - 1; the order must be total within a key.

    Rows with a null in the key are left out. Rows are joined with `beside` by its columns of `key` (an inner
    join), if it is given.
    """
    small, large = _by_size(df, key, workspace)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    found = small.withColumn(alias, (place - 1).cast("bigint"))
    if beside is not None:
        more = [name for name in beside.columns if name not in key]
        found = found.join(beside, key).select(*df.columns, *more, alias)
    return found if large is None else found.unionByName(_numbered_in_ranges(large, key, order, alias, workspace, beside))


def previous(
    df: DataFrame, key: list[str], order: list[str], value: str, alias: str, workspace: Workspace
) -> DataFrame:
    """lag(value) over (partition by key order by order); the order must be total within a key.

    Rows with a null in the key are left out.
    """
    small, large = _by_size(df, key, workspace)
    found = small.withColumn(alias, F.lag(value).over(Window.partitionBy(*key).orderBy(*order)))
    return found if large is None else found.unionByName(_previous_in_ranges(large, key, order, value, alias, workspace))


def _numbered_in_ranges(
    df: DataFrame, key: list[str], order: list[str], alias: str, workspace: Workspace, beside: DataFrame | None = None
) -> DataFrame:
    """As `numbered`, for keys of any size.

    Rows are dealt out by ranges of (key, order), so any key is spread over as many tasks as its
    rows fill; a number is the place within the range plus the key's rows in earlier ranges. A key
    has one row for each range it reaches into, which is what the window runs over.

    Rows are joined with `beside` by its columns of `key` (an inner join), if it is given. It meets those few rows
    per key first, so that the rows themselves are not shuffled once more for it.
    """
    placed = _placed(df, [*key, *order], workspace)
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*key, "_part")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
        .select(
            *key, "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
        )
    )
    more = [] if beside is None else [name for name in beside.columns if name not in key]
    if beside is not None:
        shifts = shifts.join(beside, key)
    return placed.join(shifts, [*key, "_part"]).select(
        *df.columns, *more, (F.col("_place") + F.col("_shift")).alias(alias)
    )


def _previous_in_ranges(
    df: DataFrame, key: list[str], order: list[str], value: str, alias: str, workspace: Workspace
) -> DataFrame:
    """As `previous`, for keys of any size.

    As in `_numbered_in_ranges`, the lag runs inside the ranges, and the first row of a key in a range takes the
    last value of the key's range before it.
    """
    placed = _placed(df, [*key, *order], workspace)
    inside = Window.partitionBy(*key, "_part").orderBy("_place")
    last = (
        placed.groupBy(*key, "_part")
        .agg(F.max_by(value, "_place").alias("_last"))
        .select(*key, "_part", F.lag("_last").over(Window.partitionBy(*key).orderBy("_part")).alias("_before"))
    )
    return (
        placed.withColumns({"_lag": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1})
        .join(last, [*key, "_part"])
        .select(*df.columns, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")).alias(alias))
    )


def running_sum(
    df: DataFrame, key: list[str], order: list[str], value: str, alias: str, workspace: Workspace
) -> DataFrame:
    """sum(value) over (partition by key order by order), up to the row; the order must be total within a key.

    As in `_numbered_in_ranges`, the sum runs inside the ranges, and a range carries the key's total of the ranges before
    it. The result has the type that a sum of `value` has.
    """
    placed = _placed(df, [*key, *order], workspace)
    inside = Window.partitionBy(*key, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    kind = df.agg(F.sum(value).alias(value)).schema[value].dataType
    carried = (
        placed.groupBy(*key, "_part")
        .agg(F.sum(value).alias("_total"))
        .select(*key, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).cast(kind).alias("_carry"))
    )
    return (
        placed.withColumn("_inside", F.sum(value).over(inside).cast(kind))
        .join(carried, [*key, "_part"])
        .select(*df.columns, (F.col("_inside") + F.col("_carry")).cast(kind).alias(alias))
    )


def ranked(df: DataFrame, order: list[Column], alias: str, workspace: Workspace) -> DataFrame:
    """Rank every row from 0 by `order`, which must be total.

    The rows are range-partitioned and sorted; a rank is the row's place in its partition plus
    the size of all earlier partitions.
    """
    placed = _placed(df, order, workspace)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    return placed.join(offsets, "_part").select(
        *df.columns, (F.col("_place") + F.col("_before")).alias(alias)
    )
