"""Text reports as DataFrames of lines, numbered for display, written with the text sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.plans.clusters import COUNT_TOTALS, MONEY_TOTALS


def initial_analysis_lines(analysis: DataFrame) -> DataFrame:
    """One line per item of `overview.initial_analysis`."""
    share = F.coalesce(F.concat(F.lit("\t"), F.col("percentage").cast("string")), F.lit(""))
    return analysis.select(
        F.concat(F.col("item"), F.lit("\t"), F.col("amount").cast("string"), share).alias("line")
    )


def heuristic5_lines(links: DataFrame) -> DataFrame:
    """`deposit --> withdrawal` per linked pair."""
    return links.select(F.concat("deposit_tx", F.lit(" --> "), "withdrawal_tx").alias("line"))


def cluster_lines(
    summary: DataFrame, stats: DataFrame, tags: DataFrame, coverage: DataFrame, names: DataFrame
) -> DataFrame:
    """Markdown list: the summary, then one item per cluster that holds a listed address."""
    head = summary.select(
        F.concat(F.lit("- "), "metric", F.lit(" : "), F.col("metric_value").cast("string")).alias(
            "line"
        )
    )
    tagged = stats.join(tags, "cluster_id").join(coverage, "cluster_id")
    facts = [
        "cluster_size",
        *(name for name in tags.columns if name != "cluster_id"),
        "total_distinct_txs",
        *(f"total_{name}" for name in (*MONEY_TOTALS, *COUNT_TOTALS)),
        "heuristic_miner_percentage",
        "founder_percentage",
    ]
    cluster = F.concat(F.lit("- cluster "), F.col("cluster_rank").cast("string"), F.lit(" : "))
    items = tagged.select(
        F.concat(
            cluster,
            F.concat_ws(
                ", ", *(F.concat(F.lit(f"{fact} "), F.col(fact).cast("string")) for fact in facts)
            ),
        ).alias("line")
    )
    named = stats.select("cluster_id", "cluster_rank").join(names, "cluster_id").select(
        F.concat(
            cluster, "kind", F.lit(" "), "tag", F.lit(", addresses "), F.col("addresses").cast("string")
        ).alias("line")
    )
    return head.unionByName(items).unionByName(named)
