"""Address lists: `address` or `address;tag` files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspool.operators.joins import reshuffled

# The files a study keeps its lists in.
LIST_FILES = {
    "pools": "pool_addresses.csv",
    "tags": "address_tags.csv",
    "founders": "founders_addresses.csv",
    "miners": "miners_addresses.csv",
    "heuristic_miners": "miners_heuristic_addresses.csv",
    "heuristic_founders": "founders_heuristic_addresses.csv",
}
_TAGGED = ("pools", "tags")


def _header_width(spark: SparkSession, path: str) -> int:
    first = spark.read.text(path).first()
    return len(first[0].split(";")) if first else 0


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(address, tag, values) of the lines after a header; `values` counts the fields of a line."""
    lines = spark.read.schema("line string").option("sep", "\u0001").option("quote", "").option("header", "true")
    parts = F.split("line", ";")
    field = lambda k: F.regexp_replace(F.trim(F.try_element_at(parts, F.lit(k))), '^"(.*)"$', "$1")
    return lines.csv(path).select(field(1).alias("address"), field(2).alias("tag"), F.size(parts).alias("values"))


def read_address_list(spark: SparkSession, path: str) -> DataFrame:
    """(address) or (address, tag), one row per address; the greatest tag wins on duplicates.

    A one-column list takes the first field of every line. A two-column list skips lines of other
    than two fields and keeps empty tags. Lines without an address are skipped. A header of more
    than two columns is an error.
    """
    width = _header_width(spark, path)
    if width > 2:
        raise ValueError(f"{path}: expected `address` or `address;tag`, found {width} columns")
    rows = _fields(spark, path).filter(F.coalesce(F.col("address"), F.lit("")) != "")
    if width < 2:
        return reshuffled(rows.select("address").distinct(), "address")
    tagged = rows.filter(F.col("values") == 2).groupBy("address")
    return reshuffled(tagged.agg(F.max(F.coalesce("tag", F.lit(""))).alias("tag")), "address")


def duplicated_addresses(spark: SparkSession, path: str) -> DataFrame:
    """(address, row_count) of addresses a file lists more than once."""
    rows = _fields(spark, path).filter(F.coalesce(F.col("address"), F.lit("")) != "")
    return rows.groupBy("address").agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def read_address_lists(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All six lists; a missing file is an error, as is one of the wrong width."""
    lists = {}
    for name, file in LIST_FILES.items():
        frame = read_address_list(spark, f"{folder.rstrip('/')}/{file}")
        if (name in _TAGGED) != ("tag" in frame.columns):
            raise ValueError(f"{file}: wrong number of columns")
        lists[name] = frame
    return lists
