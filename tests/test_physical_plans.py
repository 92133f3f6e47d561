"""What the plans must look like whatever the size of the data."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glasspool.operators.components import _lower
from glasspool.plans import addresses, clusters, heuristics, series
from glasspool.sources import snapshot
from testbed.catalogue import QUERIES

FOLDER = Path("/root/testdata/sf0.001")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plan as for tables too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture(scope="module")
def ledger(spark, build, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans"))
    snapshot.save_ledger(
        build.ledger(
            block=build.blocks(b=1),
            transaction=build.transactions(("t", "b", "public")),
            vout=build.vout(("t", 0, ["a"], 1)),
        ),
        path,
    )
    return snapshot.load_ledger(spark, path)


LAZY = [
    "address_stats",
    "address_profile",
    "withdrawals_by_identity_c",
    "types_cumulative",
    "pool_value_over_height",
    "founder_correlation",
    "heuristic4_miners",
    "heuristic5_links",
    "cospend_edges",
    "cluster_stats",
    "cluster_tags",
    "cluster_concentration",
    "cluster_top_addresses",
    "key_violations",
    "orphan_rows",
]


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, str(FOLDER)))
    for unwanted in ("Cartesian", "NestedLoop", "EvalPython", "InPandas", "ArrowEval"):
        assert unwanted not in plan


def test_exact_amounts_reach_the_scan(ledger):
    plan = plan_of(heuristics.heuristic3_founders(ledger.vjoinsplit, ledger.vout))
    assert "EqualTo(vj_vpub_new,250.00010000)" in plan.replace(" ", "")
    assert "cast(vj_vpub_new" not in plan


def test_positive_values_and_types_reach_the_scan(ledger):
    assert "GreaterThan(vj_vpub_old" in plan_of(series.pool_deposits(ledger))
    assert "EqualTo(t_type,deshielded)" in plan_of(addresses.pool_outputs(ledger))


def test_scans_read_only_the_columns_they_need(ledger):
    plan = plan_of(series.types_per_height(ledger))
    assert "ReadSchema: struct<t_blockhash:string,t_type:string>" in plan
    assert "b_tx" not in plan


def test_top_addresses_are_limited_before_they_are_gathered(spark, no_broadcast):
    members = spark.createDataFrame([], "address string, cluster_id string")
    stats = spark.createDataFrame(
        [], "address string, pool_sent decimal(38,8), pool_recv decimal(38,8)"
    )
    plan = plan_of(clusters.cluster_top_addresses(members, stats))
    assert plan.count("WindowGroupLimit") == 2


def test_rich_lists_take_the_top_without_a_full_sort(ledger):
    plan = plan_of(addresses.rich_list(addresses.address_stats(ledger), "recv"))
    assert "TakeOrderedAndProject" in plan


def test_only_tables_of_proven_size_are_broadcast(spark, no_broadcast, ledger):
    plan = plan_of(addresses.address_stats(ledger))
    assert "Broadcast" not in plan
    assert "Broadcast" not in plan_of(
        clusters.cluster_lookup(
            spark.createDataFrame([], "address string"),
            spark.createDataFrame([], "address string, cluster_id string"),
            spark.createDataFrame([], "cluster_id string, cluster_size bigint, cluster_rank bigint"),
        ).filter(F.col("cluster_rank") >= 0)
    )


def skew_settings(spark):
    return {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.shuffle.partitions": "16",
    }


@pytest.fixture
def eager_splitting(spark):
    """Thresholds at which a test-sized hot key counts as skewed."""
    before = {key: spark.conf.get(key) for key in skew_settings(spark)}
    for key, value in skew_settings(spark).items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def final_plan(df) -> str:
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString()


def test_a_transaction_with_most_outputs_is_split(spark, build, eager_splitting, tmp_path):
    outputs = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("vo_tx_hash"),
        F.lit(1).cast("decimal(32,8)").alias("vo_value"),
        F.col("id").alias("vo_tx_n"),
        F.array(F.sha2((F.col("id") + 7).cast("string"), 256)).alias("vo_pubkey"),
    )
    outputs.write.parquet(str(tmp_path / "vout"))
    ledger = build.ledger(
        vout=spark.read.parquet(str(tmp_path / "vout")), coingen=build.coingen("hot", "other")
    )
    assert "skew=true" in final_plan(addresses.address_stats(ledger))


def test_a_node_with_most_neighbours_is_split(spark, eager_splitting, tmp_path):
    chance = F.xxhash64("id")
    edges = spark.range(0, 120_000, 1, 8).select(
        (chance % 1_000_000_007 + 2_000_000_000).alias("node"),
        F.when(F.col("id") % 3 > 0, F.lit(5).cast("bigint")).otherwise(F.col("id") + 10).alias("parent"),
    )
    edges.write.parquet(str(tmp_path / "edges"))
    assert "skew=true" in final_plan(_lower(spark.read.parquet(str(tmp_path / "edges"))))


def hot_outputs(spark, path, address):
    """Two thirds of the outputs in one transaction; `address` is the owner of an output."""
    spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("vo_tx_hash"),
        F.lit(1).cast("decimal(32,8)").alias("vo_value"),
        F.col("id").alias("vo_tx_n"),
        F.array(address).alias("vo_pubkey"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def owner_of_each(shift=7):
    return F.sha2((F.col("id") + shift).cast("string"), 256)


def test_a_wide_transaction_is_split_in_heuristic_four(spark, build, eager_splitting, tmp_path):
    vout = hot_outputs(spark, str(tmp_path / "vout"), owner_of_each())
    pools = spark.range(3000).select(owner_of_each().alias("address"), F.lit("pool").alias("tag"))
    pools.write.parquet(str(tmp_path / "pools"))
    joinsplits = build.joinsplits(("hot", 0, 1, None, None), ("other", 0, 1, None, None))
    found = heuristics.heuristic4_miners(joinsplits, vout, spark.read.parquet(str(tmp_path / "pools")), 100)
    assert "skew=true" in final_plan(found)


def test_an_address_with_most_outputs_is_split_in_profiles(spark, build, eager_splitting, tmp_path):
    owner = F.when(F.col("id") % 3 > 0, F.lit("busy")).otherwise(owner_of_each())
    spark.range(0, 60_000, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("vo_tx_hash"),
        F.lit(1).cast("decimal(32,8)").alias("vo_value"),
        F.col("id").alias("vo_tx_n"),
        F.array(owner).alias("vo_pubkey"),
    ).write.parquet(str(tmp_path / "vout"))
    ledger = build.ledger(
        block=build.blocks(b=1), vout=spark.read.parquet(str(tmp_path / "vout")),
        coingen=build.coingen("x"), vjoinsplit=build.joinsplits(("y", 1, 0, None, None)),
    )
    wanted = build.addresses("busy", *(str(k) for k in range(500)))
    assert "skew=true" in final_plan(addresses.address_profile(ledger, wanted))
