"""Versions of a stored ledger: loads, and small commits that name the loads of a version.

A load writes its rows below `<table>.parquet/load=<id>`, a folder no other load shares, and nothing
reads them before a commit names the load. A commit is one row per load below `commits/version=<n>`;
readers take the greatest version. So a load that breaks, or is refused, leaves the store as it was, and a
saved snapshot replaces the one before as a whole. One writer at a time; two that meet write the same
version, and the second fails.

Outputs and transactions are stored by part, a hash of the transaction: a load that spends outputs, or
checks whether a transaction is known, reads only the parts it names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from glasspool import schema

PARTS = 64

#: the column whose hash names the part
PARTED = {"transaction": "t_tx_hash", "vout": "vo_tx_hash"}

_COMMIT = "load string, top long, parts int"
_STORE = ""  # the row of a commit that stands for the store itself


@dataclass(frozen=True)
class Version:
    """The loads of a version with the greatest height of each, and the number of parts."""

    number: int
    loads: dict[str, int]
    parts: int = PARTS

    @property
    def height(self) -> int:
        return max([0, *self.loads.values()])


def table_path(path: str, table: str) -> str:
    return f"{path.rstrip('/')}/{table}.parquet"


def _commits(path: str) -> str:
    return f"{path.rstrip('/')}/commits"


def current(spark: SparkSession, path: str) -> Version | None:
    """The version readers see; None where nothing was committed yet."""
    kind = StructType([*StructType.fromDDL(_COMMIT).fields, StructField("version", IntegerType())])
    try:
        commits = spark.read.schema(kind).option("basePath", _commits(path)).parquet(_commits(path))
    except AnalysisException:
        return None
    newest = commits.agg(F.max("version")).first()[0]
    if newest is None:
        return None
    rows = commits.filter(F.col("version") == newest).collect()
    loads = {row["load"]: row["top"] for row in rows if row["load"] != _STORE}
    return Version(newest, loads, rows[0]["parts"])


def commit(spark: SparkSession, path: str, version: Version) -> None:
    """Make a version the current one. Its number must be new."""
    rows = [(_STORE, 0, version.parts), *((load, top, version.parts) for load, top in sorted(version.loads.items()))]
    target = f"{_commits(path)}/version={version.number}"
    spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("errorifexists").parquet(target)


def following(version: Version | None, load: str, top: int, append: bool, parts: int = PARTS) -> Version:
    """The version after one more load; without `append` the load stands alone."""
    if version is None:
        return Version(1, {load: top}, parts)
    kept = version.loads if append else {}
    return replace(version, number=version.number + 1, loads={**kept, load: top})


def fresh_load() -> str:
    return uuid.uuid4().hex


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_load(
    rows: DataFrame,
    path: str,
    table: str,
    load: str,
    parts: int,
    last: Callable[[DataFrame], DataFrame] = lambda dealt: dealt,
) -> DataFrame:
    """Store the rows of one table of a load and read them back.

    Rows of a parted table are dealt out by part, and a part over as many tasks as the shuffle has
    partitions for it. Not by ranges: finding their bounds would run the source twice. `last` is applied to
    the dealt rows of a parted table, in the stage that writes them.
    """
    target = f"{table_path(path, table)}/load={load}"
    if table not in PARTED:
        rows.write.parquet(target, compression="zstd")
        return rows.sparkSession.read.schema(rows.schema).parquet(target)
    spark, key = rows.sparkSession, F.col(PARTED[table])
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)
    salt = F.pmod(F.shiftright(F.xxhash64(key), 20), F.lit(spread))
    parted = last(rows.withColumn("part", part_of(key, parts)).repartition("part", salt))
    parted.write.partitionBy("part").parquet(target, compression="zstd")
    return _read(spark, path, table, [load], None)


def _read(spark: SparkSession, path: str, table: str, loads: list[str], parts: list[int] | None) -> DataFrame:
    kind = schema.CLEAN[table]
    if not loads:
        return spark.createDataFrame([], kind)
    folder = table_path(path, table)
    parted = table in PARTED
    folders = [StructField("load", StringType()), *([StructField("part", IntegerType())] if parted else [])]
    found = spark.read.schema(StructType([*kind.fields, *folders])).option("basePath", folder)
    found = found.parquet(*(f"{folder}/load={load}" for load in sorted(loads)))
    if parted and parts is not None:
        found = found.filter(F.col("part").isin(parts))
    return found.select(*kind.names)


def read_table(spark: SparkSession, path: str, table: str, version: Version, parts: list[int] | None = None) -> DataFrame:
    """One table of a version, or only some parts of it."""
    return _read(spark, path, table, list(version.loads), parts)


def parts_named(rows: DataFrame, key: str, parts: int) -> list[int]:
    """The parts that the keys of the rows fall into, at most `parts` numbers."""
    found = rows.select(part_of(F.col(key), parts).alias("part")).filter(F.col(key).isNotNull()).distinct()
    return sorted(row["part"] for row in found.collect())


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the loads that the current version does not name; returns them.

    Readers of an older version, and a load that is being written, must not be at work.
    """
    version = current(spark, path)
    if version is None:
        return []
    removed = set()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for table in schema.CLEAN:
        folder = hadoop(table_path(path, table))
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(folder) if files.exists(folder) else []:
            load = status.getPath().getName().removeprefix("load=")
            if load not in version.loads:
                files.delete(status.getPath(), True)
                removed.add(load)
    return sorted(removed)
