import os
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from glasspool import Ledger, Workspace, schema  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("glasspool-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", os.environ.get("TEST_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def workspace(spark):
    return Workspace.of(spark)


def money(value):
    return None if value is None else Decimal(str(value))


class Build:
    """Frames of the clean tables from short tuples."""

    def __init__(self, spark):
        self.spark = spark

    def frame(self, kind, rows):
        return self.spark.createDataFrame(rows, kind)

    def addresses(self, *names):
        return self.frame(schema.ADDRESS_LIST, [(name,) for name in names])

    def tagged(self, **tags):
        return self.frame(schema.ADDRESS_TAGS, list(tags.items()))

    def transactions(self, *rows):
        """(hash, block hash, type)"""
        return self.frame(
            schema.TRANSACTION, [(tx, block, 0, 0, True, 0, 0, 0, kind) for tx, block, kind in rows]
        )

    def blocks(self, **heights):
        return self.frame(
            schema.BLOCK,
            [(height, name, 1, 4, None, 0, "", "") for name, height in heights.items()],
        )

    def coingen(self, *hashes):
        return self.frame(schema.COINGEN, [(tx, "cb", 0) for tx in hashes])

    def vin(self, *rows):
        """(tx, previous tx, n, addresses, value)"""
        return self.frame(
            schema.VIN_RESOLVED, [(tx, prev, n, owner, money(v)) for tx, prev, n, owner, v in rows]
        )

    def vout(self, *rows):
        """(tx, n, addresses, value)"""
        return self.frame(schema.VOUT, [(tx, money(v), n, owner) for tx, n, owner, v in rows])

    def joinsplits(self, *rows):
        """(tx, in, out, sources, destinations)"""
        return self.frame(
            schema.VJOINSPLIT,
            [(tx, money(old), money(new), src, dst) for tx, old, new, src, dst in rows],
        )

    def ledger(self, **tables):
        return Ledger.empty(self.spark).with_tables(**tables)


@pytest.fixture(scope="session")
def build(spark):
    return Build(spark)


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)
