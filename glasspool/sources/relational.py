"""Staging tables in a relational store, read in parallel ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glasspool.ledger import Ledger
from glasspool.operators.normalize import clean_tables, normalize
from glasspool.sources.snapshot import load_ledger, save_clean

# Table names of the staging store, and a numeric column to split each by.
_TABLES = {
    "block": ("blocks", "height"),
    "transaction": ("transactions", "blocktime"),
    "coingen": ("coingen", "db_id"),
    "vin": ("vin", "db_id"),
    "vout": ("vout", "db_id"),
    "vjoinsplit": ("vjoinsplit", "db_id"),
}


def read_staging(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    bounds: dict[str, tuple[int, int]],
    partitions: int,
) -> dict[str, DataFrame]:
    """The six staging tables. `bounds` gives the range of each table's splitting column."""
    return {
        name: spark.read.jdbc(
            url,
            table,
            column=column,
            lowerBound=bounds[name][0],
            upperBound=bounds[name][1],
            numPartitions=partitions,
            properties=properties,
        )
        for name, (table, column) in _TABLES.items()
    }


def load_relational(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    bounds: dict[str, tuple[int, int]],
    partitions: int,
    height_limit: int | None = None,
) -> Ledger:
    return normalize(read_staging(spark, url, properties, bounds, partitions), height_limit)


def import_relational(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    bounds: dict[str, tuple[int, int]],
    partitions: int,
    path: str,
    height_limit: int | None = None,
) -> Ledger:
    """Staging tables to a stored ledger; every table is fetched once."""
    staged = read_staging(spark, url, properties, bounds, partitions)
    save_clean(spark, clean_tables(staged, height_limit), path)
    return load_ledger(spark, path)
