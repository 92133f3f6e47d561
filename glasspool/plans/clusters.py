"""Co-spend clusters: ranks, statistics, tags and concentration.

Membership stays in long form, `clusters(address, cluster_id)`: the largest cluster can hold a
large share of all addresses and must never become one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasspool.functions.money import count_percent, percent, total
from glasspool.operators.joins import reshuffled
from glasspool.operators.components import component_links
from glasspool.operators.positions import ranked
from glasspool.plans.heuristics import founder_union
from glasspool.settings import CLUSTER_TOP_ADDRESSES, CONCENTRATION_TOPS, SUMMARY_TOPS
from glasspool.workspace import Workspace

MONEY_TOTALS = ("current_value", "pool_recv", "pool_sent", "recv", "sent")
COUNT_TOTALS = (
    "coingens_recv",
    "no_txs_total",
    "txs_recv",
    "txs_sent",
    "vins_count",
    "vouts_count",
)


@dataclass(frozen=True)
class AddressLists:
    """Known and derived addresses; `pools` and `tags` are (address, tag), the rest (address)."""

    pools: DataFrame
    miners: DataFrame
    founders: DataFrame
    heuristic_miners: DataFrame
    heuristic_founders: DataFrame
    tags: DataFrame


def cluster_ranks(clusters: DataFrame, workspace: Workspace) -> DataFrame:
    """(cluster_id, cluster_size, cluster_rank), largest first from 0; ties by id."""
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return ranked(sizes, [F.desc("cluster_size"), F.asc("cluster_id")], "cluster_rank", workspace)


def cluster_summary(
    ranks: DataFrame, transaction: DataFrame, tops: Sequence[int] = SUMMARY_TOPS
) -> DataFrame:
    """(metric, metric_value): counts, largest size, and addresses held by the top clusters."""
    size, rank = F.col("cluster_size"), F.col("cluster_rank")
    zero = F.lit(0).cast("bigint")
    metrics = {
        "clusters": F.count(F.lit(1)),
        "largest_cluster": F.coalesce(F.max(size), zero),
        **{
            f"addresses_in_top_{top}": F.coalesce(F.sum(F.when(rank < top, size)), zero)
            for top in tops
        },
        "clustered_addresses": F.coalesce(F.sum(size), zero),
    }
    summary = ranks.agg(*(value.alias(name) for name, value in metrics.items()))
    transactions = transaction.agg(F.count(F.lit(1)).alias("transactions"))
    return summary.unpivot([], list(metrics), "metric", "metric_value").unionByName(
        transactions.unpivot([], ["transactions"], "metric", "metric_value")
    )


def member_stats(clusters: DataFrame, stats: DataFrame) -> DataFrame:
    """Cluster members with their address statistics (members without any are left out)."""
    return clusters.join(stats, "address")


def members_without_stats(clusters: DataFrame, stats: DataFrame) -> DataFrame:
    """Members that only ever occur next to other addresses in one output."""
    return clusters.join(stats.select("address"), "address", "left_anti")


def cluster_transactions(clusters: DataFrame, pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """(tx_hash, cluster_id) of multi-input transactions with a member that has statistics.

    All inputs of a transaction are in one cluster, so its least such address stands for it.
    """
    representative = (
        pairs.join(stats.select("address"), "address", "left_semi")
        .groupBy("tx_hash")
        .agg(F.min("address").alias("address"))
    )
    return representative.join(clusters, "address").select("tx_hash", "cluster_id")


def cluster_stats(
    clusters: DataFrame, ranks: DataFrame, pairs: DataFrame, stats: DataFrame
) -> DataFrame:
    """One row per cluster: rank, size, summed member statistics, distinct transactions."""
    members = member_stats(clusters, stats)
    sums = members.groupBy("cluster_id").agg(
        *(total(F.col(name)).alias(f"total_{name}") for name in MONEY_TOTALS),
        *(F.sum(name).alias(f"total_{name}") for name in COUNT_TOTALS),
    )
    transactions = (
        cluster_transactions(clusters, pairs, stats)
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("total_distinct_txs"))
    )
    joined = ranks.join(sums, "cluster_id", "left").join(transactions, "cluster_id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "cluster_rank",
        "cluster_id",
        "cluster_size",
        *(
            F.coalesce(f"total_{name}", F.lit(0)).cast("decimal(38,8)").alias(f"total_{name}")
            for name in MONEY_TOTALS
        ),
        *(F.coalesce(f"total_{name}", zero).alias(f"total_{name}") for name in COUNT_TOTALS),
        F.coalesce("total_distinct_txs", zero).alias("total_distinct_txs"),
    )


_LISTS = ("pool", "miner", "founder", "heuristic_miner", "heuristic_founder", "tag")


def _labelled(lists: AddressLists) -> DataFrame:
    """All lists as (address, kind, tag), one row per address and list."""
    untagged = F.lit(None).cast("string").alias("tag")
    frames = zip(
        _LISTS,
        (
            lists.pools.select("address", "tag"),
            lists.miners.select("address", untagged),
            lists.founders.select("address", untagged),
            lists.heuristic_miners.select("address", untagged),
            lists.heuristic_founders.select("address", untagged),
            lists.tags.select("address", "tag"),
        ),
    )
    labelled = [frame.withColumn("kind", F.lit(kind)) for kind, frame in frames]
    return (
        reduce(DataFrame.unionByName, labelled)
        .groupBy("address", "kind")
        .agg(F.max("tag").alias("tag"))
    )


def cluster_tags(clusters: DataFrame, lists: AddressLists) -> DataFrame:
    """Clusters holding at least one listed address: the number of addresses of each list."""
    kind = F.col("kind")
    return (
        clusters.join(reshuffled(_labelled(lists), "address"), "address")
        .groupBy("cluster_id")
        .agg(*(F.count_if(kind == of).alias(f"{of}_count") for of in _LISTS))
    )


def cluster_tag_names(clusters: DataFrame, lists: AddressLists) -> DataFrame:
    """(cluster_id, kind, tag, addresses): the pools and tags that each cluster holds, one row each.

    In long form, because one cluster may hold most names of a list of any size.
    """
    named = _labelled(lists).filter(F.col("kind").isin("pool", "tag"))
    return (
        clusters.join(reshuffled(named, "address"), "address")
        .groupBy("cluster_id", "kind", "tag")
        .agg(F.count(F.lit(1)).alias("addresses"))
    )


def cluster_table(stats: DataFrame, tags: DataFrame) -> DataFrame:
    """`cluster_stats` with the number of listed addresses per list, 0 where there are none."""
    counts = [f"{of}_count" for of in _LISTS]
    zero = F.lit(0).cast("bigint")
    return stats.join(tags.select("cluster_id", *counts), "cluster_id", "left").select(
        *stats.columns, *(F.coalesce(name, zero).alias(name) for name in counts)
    )


def cluster_tag_coverage(tags: DataFrame, lists: AddressLists) -> DataFrame:
    """Share of all heuristic miners, and of all founders, that each tagged cluster holds."""
    all_miners = lists.heuristic_miners.select("address").distinct().agg(F.count(F.lit(1)))
    all_founders = founder_union(lists.heuristic_founders, lists.founders).agg(F.count(F.lit(1)))
    return tags.select(
        "cluster_id",
        count_percent(F.col("heuristic_miner_count"), all_miners.scalar()).alias(
            "heuristic_miner_percentage"
        ),
        count_percent(
            F.col("heuristic_founder_count") + F.col("founder_count"), all_founders.scalar()
        ).alias("founder_percentage"),
    )


CONCENTRATION_METRICS = (
    "cluster_size",
    *(f"total_{name}" for name in MONEY_TOTALS),
    *(f"total_{name}" for name in COUNT_TOTALS),
    "total_distinct_txs",
)


def cluster_concentration(
    stats: DataFrame,
    total_addresses: Column | None = None,
    total_transactions: Column | None = None,
    tops: Sequence[int] = CONCENTRATION_TOPS,
) -> DataFrame:
    """(metric, total, top_5 ... top_all): per cent of each metric held by the largest clusters.

    Sizes and distinct transactions are measured against the whole ledger when its totals are
    given, every other metric against its sum over all clusters.
    """
    held = [*(f"top_{top}" for top in tops), "top_all"]
    inside = [*(F.col("cluster_rank") < top for top in tops), F.lit(True)]
    amounts = {name: F.col(name).cast("decimal(38,8)") for name in CONCENTRATION_METRICS}
    # one row: a structure for each metric; clusters are read once and no row is multiplied
    sums = (
        stats.agg(
            *(
                F.struct(*(F.sum(F.when(rows, value)).alias(name) for name, rows in zip(held, inside))).alias(metric)
                for metric, value in amounts.items()
            )
        )
        .unpivot([], list(amounts), "metric", "held")
        .select("metric", "held.*")
    )
    whole = F.col("top_all")
    if total_addresses is not None:
        whole = F.when(F.col("metric") == "cluster_size", total_addresses).otherwise(whole)
    if total_transactions is not None:
        whole = F.when(F.col("metric") == "total_distinct_txs", total_transactions).otherwise(whole)
    whole = whole.cast("decimal(38,8)")
    return sums.withColumn("total", whole).select(
        "metric", "total", *(percent(F.col(name), F.col("total")).alias(name) for name in held)
    )


def largest_cluster_links(links: DataFrame, clusters: DataFrame, ranks: DataFrame) -> DataFrame:
    """(tx_hash, src, dst) links of the largest cluster."""
    return component_links(links, clusters, ranks.filter("cluster_rank = 0"))


def cluster_lookup(addresses: DataFrame, clusters: DataFrame, ranks: DataFrame) -> DataFrame:
    """(cluster_rank, cluster_id, address) of those given addresses that are in a cluster."""
    found = clusters.join(addresses.select("address"), "address", "left_semi")
    return found.join(ranks, "cluster_id").select("cluster_rank", "cluster_id", "address")


def cluster_top_addresses(
    clusters: DataFrame, stats: DataFrame, top: int = CLUSTER_TOP_ADDRESSES
) -> DataFrame:
    """Per cluster and side (deposited, withdrawn): the top addresses, the total, and how many.

    The rank filter is applied inside each map task before rows are gathered by cluster, so a
    cluster with very many members contributes at most `top` rows per task.
    """
    sides = (
        member_stats(clusters, stats)
        .select(
            "cluster_id",
            "address",
            F.explode(
                F.array(
                    F.struct(F.lit("deposited").alias("side"), F.col("pool_sent").alias("amount")),
                    F.struct(F.lit("withdrawn").alias("side"), F.col("pool_recv").alias("amount")),
                )
            ).alias("flow"),
        )
        .select("cluster_id", "address", "flow.*")
        .filter("amount > 0")
    )
    totals = sides.groupBy("cluster_id", "side").agg(
        total(F.col("amount")).alias("side_total"), F.count(F.lit(1)).alias("side_addresses")
    )
    best = Window.partitionBy("cluster_id", "side").orderBy(F.desc("amount"), "address")
    leaders = sides.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)
    return leaders.join(totals, ["cluster_id", "side"])
