"""Exact amounts. Money is decimal(32,8) in tables and decimal(38,8) in totals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasspool.schema import MONEY, MONEY_TOTAL


def amount(value: Decimal) -> Column:
    """A literal of the column type, so that comparisons reach the Parquet scan."""
    return F.lit(value).cast(MONEY)


def to_money(column: Column) -> Column:
    """Text, floating point or decimal as money, rounded half up to 8 places by the cast.

    Totals pass through here before they are added or subtracted.
    """
    return column.cast(MONEY)


def total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast(MONEY_TOTAL)


def difference(left: Column, right: Column) -> Column:
    """`left - right` of two totals without losing the eighth place."""
    return (left.cast(MONEY) - right.cast(MONEY)).cast(MONEY_TOTAL)


def percent(part: Column, whole: Column) -> Column:
    """`100 * part / whole` to 2 places, half up; null when `whole` is 0."""
    share = F.try_divide(part.cast("decimal(28,8)") * F.lit(100), whole.cast("decimal(28,8)"))
    return F.round(share, 2).cast("decimal(18,2)")


def count_percent(part: Column, whole: Column) -> Column:
    share = F.try_divide(part.cast("decimal(19,0)") * F.lit(100), whole.cast("decimal(19,0)"))
    return F.round(share, 2).cast("decimal(18,2)")
