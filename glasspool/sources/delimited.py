"""`;`-delimited files: ledger dumps in, statistics and lists out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glasspool import schema
from glasspool.functions.arrays import parse_array_text
from glasspool.ledger import Ledger
from glasspool.operators.normalize import clean_tables, normalize
from glasspool.settings import GENESIS_TX
from glasspool.sources.snapshot import load_ledger, save_clean

_SEPARATOR = ";"

# An empty field is null and a quoted empty field is '', as relational dumps write them. Spark
# keeps the two apart on reading only if the null mark is not itself empty.
NULL_MARK = "\\N"

# The file each table is dumped to.
DUMP_FILES = {name: f"public.{name}.csv" for name in Ledger.names()}


def read_csv(spark: SparkSession, path: str, kind: StructType) -> DataFrame:
    """A result written by `write_csv`."""
    return (
        spark.read.schema(kind)
        .option("sep", _SEPARATOR)
        .option("header", "true")
        .option("mode", "FAILFAST")
        .option("nullValue", NULL_MARK)
        .csv(path)
    )


def read_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One dump, typed, with its text arrays parsed. A value of the wrong type stops the job."""
    raw = read_csv(spark, path, schema.dump_schema(table))
    parsed = {
        field.name: parse_array_text(F.col(field.name)).alias(field.name)
        for field in schema.STAGING[table].fields
        if field.dataType == schema.STRINGS
    }
    return raw.select(*(parsed.get(name, F.col(name)) for name in raw.columns))


def read_dumps(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        name: read_dump(spark, f"{folder.rstrip('/')}/{file}", name)
        for name, file in DUMP_FILES.items()
    }


def load_dumps(
    spark: SparkSession,
    folder: str,
    height_limit: int | None = None,
    genesis_tx: str | None = GENESIS_TX,
) -> Ledger:
    """Dumps to a ledger: parse, prune, limit, resolve, enrich."""
    return normalize(read_dumps(spark, folder), height_limit, genesis_tx)


def import_dumps(
    spark: SparkSession,
    folder: str,
    path: str,
    height_limit: int | None = None,
    genesis_tx: str | None = GENESIS_TX,
) -> Ledger:
    """Dumps to a stored ledger. Every dump is parsed once; see `snapshot.save_clean`."""
    clean = clean_tables(read_dumps(spark, folder), height_limit)
    save_clean(spark, clean, path, genesis_tx)
    return load_ledger(spark, path)


def write_csv(df: DataFrame, path: str) -> None:
    """Any flat result as `;` CSV with a header; array columns become comma-joined text."""
    flat = [
        F.array_join(field.name, ",").alias(field.name)
        if field.dataType == schema.STRINGS
        else F.col(field.name)
        for field in df.schema.fields
    ]
    (
        df.select(*flat)
        .write.mode("overwrite")
        .option("sep", _SEPARATOR)
        .option("header", "true")
        .csv(path)
    )


def write_rich_list(top: DataFrame, path: str, value_header: str) -> None:
    """A rich list as `Address;<value header>`, in order, in one file: it has one row per rank."""
    address, value = top.columns
    ordered = top.orderBy(F.desc(value), address).select(
        F.col(address).alias("Address"), F.col(value).alias(value_header)
    )
    write_csv(ordered.coalesce(1), path)


def write_address_list(addresses: DataFrame, path: str) -> None:
    write_csv(addresses.select("address"), path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
