"""Every registered query against DuckDB on the smallest test tables, and ledger invariants."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from testbed.catalogue import QUERIES, open_testbed, stored_clusters, stored_links, stored_stats
from testbed.oracle import ORACLES

FOLDER = Path("/root/testdata/sf0.001")
TABLES = ("orders", "lineitem", "customer")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def testbed(spark):
    return open_testbed(spark, str(FOLDER))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    found = contract.queries()[name](spark, str(FOLDER))
    answer = duck.execute(contract.oracle_sql()[name])
    columns = [column[0] for column in answer.description]
    assert sorted(columns) == sorted(found.columns)
    expected = sorted(tuple(map(str, row)) for row in answer.fetchall())
    assert sorted(tuple(map(str, row)) for row in found.select(columns).collect()) == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def scalar(df):
    return df.first()[0]


def test_values_reconcile(testbed):
    ledger, stats = testbed.ledger(), stored_stats(testbed)
    assert scalar(stats.agg(F.sum("recv"))) == scalar(ledger.vout.agg(F.sum("vo_value")))
    assert scalar(stats.agg(F.sum("sent"))) == scalar(ledger.vin.agg(F.sum("vi_value")))
    assert scalar(stats.agg(F.sum("vins_count"))) == ledger.vin.count()


def test_no_output_is_spent_twice(testbed):
    vin = testbed.vin()
    assert vin.select("vi_prevout_hash", "vi_prevout_n").distinct().count() == vin.count()


def test_last_pool_value_is_deposits_less_withdrawals(spark, testbed):
    joinsplits = testbed.vjoinsplit()
    last = contract.queries()["pool_value_over_height"](spark, str(FOLDER)).orderBy(
        F.desc("height")
    ).first()
    net = joinsplits.agg(F.sum("vj_vpub_old"), F.sum("vj_vpub_new")).first()
    assert last["pool_value"] == Decimal(net[0] - net[1])


def test_types_add_up(spark, testbed):
    last = contract.queries()["types_cumulative"](spark, str(FOLDER)).orderBy(
        F.desc("height")
    ).first()
    assert sum(last[1:]) == testbed.transaction().count()


def test_a_transaction_lies_in_one_cluster(testbed):
    links, clusters = stored_links(testbed), stored_clusters(testbed)
    ends = links.join(clusters.select(F.col("address").alias("src"), F.col("cluster_id").alias("c1")), "src")
    ends = ends.join(clusters.select(F.col("address").alias("dst"), F.col("cluster_id").alias("c2")), "dst")
    assert ends.count() == links.count()
    assert ends.filter("c1 <> c2").count() == 0
