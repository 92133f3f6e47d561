"""Address arrays: parsing from text, flattening, and the address key used for statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_addresses() -> Column:
    return F.array().cast("array<string>")


def parse_array_text(text: Column) -> Column:
    """`Set(a, b)`, `{a,b}` or `[a, b]` as an array; blanks are dropped, nothing left gives []."""
    bare = F.when(text.contains("Set("), F.regexp_replace(text, r"Set\(|\)| ", "")).otherwise(
        F.regexp_replace(text, r"[{}\[\] ]", "")
    )
    return F.when(bare == "", no_addresses()).otherwise(F.split(bare, ","))


def first_address(addresses: Column) -> Column:
    """The first element; null for a null or empty array."""
    return F.get(addresses, F.lit(0))


def first_address_or_blank(addresses: Column) -> Column:
    """The first element; '' for an empty array, null for a null one."""
    return F.when(F.size(addresses) == 0, F.lit("")).otherwise(first_address(addresses))


def singleton_or_blank(addresses: Column) -> Column:
    """The element of a one-element array, '' for any other array, null for a null one."""
    return F.when(F.size(addresses) == 1, first_address(addresses)).when(
        addresses.isNotNull(), F.lit("")
    )


def address_key(addresses: Column) -> Column:
    """One string per address set: the address itself, '' for none, a sorted list for several."""
    return F.when(F.size(addresses) == 1, first_address(addresses)).otherwise(
        F.array_join(F.sort_array(addresses), ",")
    )


def distinct_sorted(addresses: Column) -> Column:
    return F.sort_array(F.array_distinct(addresses))

