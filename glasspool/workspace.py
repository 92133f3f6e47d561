"""Written tables: the hand-off between jobs, and the lineage cut inside iterative ones.

Everything is written below the folder named by `spark.checkpoint.dir`, which every executor of a
cluster can reach. A lost executor only repeats the tasks it ran: finished tables are files, not
blocks on the executor.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SMALLER = "zstd"  # for tables of a ledger, which are larger than what is computed on them at a time


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A session on one machine that names none gets a temporary folder, removed when the program ends;
    on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="glasspool-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


class Workspace:
    """Tables of one run, each written once and then read back as Parquet."""

    _sessions: dict[str, Workspace] = {}

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = f"{root or shared_folder(spark)}/glasspool-{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession) -> Workspace:
        """The workspace of this Spark application."""
        application = spark.conf.get("spark.app.id")
        if application not in cls._sessions:
            cls._sessions[application] = cls(spark)
        return cls._sessions[application]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def fresh_path(self, name: str) -> str:
        """A path no other call has been given."""
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table called `name`, built on first use."""
        if name not in self._tables:
            # a build that failed half-way is replaced by the next attempt
            self._tables[name] = self.store(build(), self.path(name), overwrite=True, compression=SMALLER)
        return self._tables[name]

    def store(
        self, df: DataFrame, path: str | None = None, overwrite: bool = False, compression: str = "snappy"
    ) -> DataFrame:
        """Write `df` and read it back, so that later plans start from files."""
        path = path or self.fresh_path("table")
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)
