"""Co-spend edges and their connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.operators.inputs import source_addresses
from glasspool.operators.joins import reshuffled
from glasspool.workspace import Workspace


def _centres(vin: DataFrame) -> DataFrame:
    """(tx_hash, src): the least input address of transactions with more than one."""
    return (
        vin.groupBy(F.col("vi_tx_hash").alias("tx_hash"))
        .agg(F.min(F.array_min("vi_address")).alias("src"), F.max(F.array_max("vi_address")).alias("_greatest"))
        .filter(F.col("src") != F.col("_greatest"))
        .select("tx_hash", "src")
        .transform(reshuffled, "tx_hash")
    )


def cospend_links(vin: DataFrame) -> DataFrame:
    """(tx_hash, src, dst): the least input address of a transaction linked to each other one.

    Transactions with a single distinct input address give no row.
    """
    pairs = source_addresses(vin)
    return (
        pairs.join(_centres(vin), "tx_hash")
        .filter(F.col("address") != F.col("src"))
        .select("tx_hash", "src", F.col("address").alias("dst"))
    )


def cospend_edges(links: DataFrame) -> DataFrame:
    """Distinct (src, dst) with src < dst."""
    return links.select("src", "dst").distinct()


def multi_input_pairs(vin: DataFrame) -> DataFrame:
    """(tx_hash, address) for transactions with more than one distinct input address."""
    pairs = source_addresses(vin)
    return pairs.join(_centres(vin).select("tx_hash"), "tx_hash", "left_semi")


def _lower(edges: DataFrame) -> DataFrame:
    """One round: hang edges from their lower end's least neighbour, then merge parents.

    An edge is (node, parent) with parent < node. `moved` marks edges the round changed.
    """
    least = edges.groupBy("node").agg(F.min("parent").alias("_least"))
    # large star: the parent is replaced by its own least neighbour, if it has a smaller one
    by_parent = reshuffled(least.withColumnRenamed("node", "parent"), "parent")
    raised = edges.join(by_parent, "parent", "left").select(
        "node",
        F.coalesce("_least", "parent").alias("parent"),
        F.col("_least").isNotNull().alias("moved"),
    )
    # small star: a node and its other parents all hang from the least of them
    least = raised.groupBy("node").agg(F.min("parent").alias("_least"))
    merged = raised.join(reshuffled(least, "node"), "node")
    kept = F.struct("node", F.col("_least").alias("parent"), "moved")
    sideways = F.struct(
        F.col("parent").alias("node"), F.col("_least").alias("parent"), F.lit(True).alias("moved")
    )
    return (
        merged.select(
            F.explode(
                F.when(F.col("parent") == F.col("_least"), F.array(kept)).otherwise(
                    F.array(kept, sideways)
                )
            ).alias("edge")
        )
        .select("edge.*")
        .groupBy("node", "parent")
        .agg(F.bool_or("moved").alias("moved"))
    )


def _inner_marked(edges: DataFrame) -> DataFrame:
    """(node, parent, inner): false where the node has no other parent and is no parent."""
    parents = edges.select(F.col("parent").alias("node")).distinct()
    several = edges.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("node")
    inner = parents.unionByName(several).distinct().withColumn("_inner", F.lit(True))
    return edges.join(reshuffled(inner, "node"), "node", "left").select(
        "node", "parent", F.col("_inner").isNotNull().alias("inner")
    )


def _numbered(edges: DataFrame, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """(address, id) of every node, ids in address order, and the edges in terms of ids.

    Rounds shuffle and compare 8-byte numbers instead of addresses. The ids are written before
    they are used, because the range bounds behind them are sampled.
    """
    named = workspace.store(edges.select("src", "dst"))
    nodes = (
        named.select(F.explode(F.array("src", "dst")).alias("address"))
        .distinct()
        .repartitionByRange("address")
        .sortWithinPartitions("address")
        .withColumn("id", F.monotonically_increasing_id())
    )
    names = workspace.store(nodes)
    ends = [
        names.select(F.col("address").alias(end), F.col("id").alias(f"{end}_id"))
        for end in ("src", "dst")
    ]
    numbered = named.join(ends[0], "src").join(ends[1], "dst")
    return names, numbered.select(
        F.greatest("src_id", "dst_id").alias("node"), F.least("src_id", "dst_id").alias("parent")
    )


def connected_components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """(address, cluster_id) of every node of (src, dst); the id is the least address.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) over oriented edges. Joins
    and aggregates only: a node with very many neighbours is absorbed by partial aggregation and
    split by adaptive skew joins, never gathered. Rounds are written, so lineage does not grow.

    After a round, leaves (nodes that hang from one parent and that nothing hangs from) are set aside: what
    joins them joins their parent, and a leaf is never the least of its cluster. So later rounds run over the
    edges between inner nodes only, and at the end leaves take the root of their parent, latest first.
    """
    names, numbered = _numbered(edges, workspace)
    slot = workspace.fresh_path("components-round")
    current, leaves = workspace.store(numbered.filter("node <> parent").distinct()), []
    while True:
        following = workspace.store(_lower(current), slot, overwrite=True)
        if not following.agg(F.bool_or("moved")).first()[0]:
            break
        split = workspace.store(_inner_marked(following.select("node", "parent")))
        leaves.append(split.filter("not inner").select("node", "parent"))
        current = split.filter("inner").select("node", "parent")
    # written layer by layer, or the plan would name the layers before it again and again
    members = following.select("node", "parent")
    for hung in reversed(leaves):
        above = members.select(F.col("node").alias("parent"), F.col("parent").alias("_root"))
        rooted = hung.join(reshuffled(above, "parent"), "parent", "left")
        members = members.unionByName(workspace.store(rooted.select("node", F.coalesce("_root", "parent").alias("parent"))))
    members = members.select(F.col("node").alias("id"), "parent").unionByName(
        members.select(F.col("parent").alias("id"), "parent").distinct()
    )
    roots = names.select(F.col("id").alias("parent"), F.col("address").alias("cluster_id"))
    return members.join(names, "id").join(roots, "parent").select("address", "cluster_id")


def extended_components(members: DataFrame, edges: DataFrame, workspace: Workspace) -> DataFrame:
    """(address, cluster_id) after more edges (src, dst), from the clusters before them.

    The ends of the new edges are replaced by the clusters they are in, so the rounds run over the new
    edges only, however many there were before. A cluster that meets others takes the least id among
    them, which is the least address of them all; addresses that were in no cluster join theirs.
    """
    fresh = workspace.store(edges.select("src", "dst").distinct())
    touched = fresh.select(F.explode(F.array("src", "dst")).alias("address")).distinct()
    # only the clusters of the new edges' ends; the rest of the members is read once more, to be relabelled
    known = workspace.store(
        touched.join(members, "address", "left").select("address", F.coalesce("cluster_id", "address").alias("label"), F.col("cluster_id").isNull().alias("is_new"))
    )
    ends = [known.select(F.col("address").alias(end), F.col("label").alias(f"{end}_label")) for end in ("src", "dst")]
    contracted = (
        fresh.join(reshuffled(ends[0], "src"), "src")
        .join(reshuffled(ends[1], "dst"), "dst")
        .filter("src_label <> dst_label")
        .select(F.least("src_label", "dst_label").alias("src"), F.greatest("src_label", "dst_label").alias("dst"))
        .distinct()
    )
    merged = workspace.store(connected_components(contracted, workspace)).select(
        F.col("address").alias("cluster_id"), F.col("cluster_id").alias("_joined")
    )
    relabelled = members.join(merged.filter("cluster_id <> _joined"), "cluster_id", "left").select(
        "address", F.coalesce("_joined", "cluster_id").alias("cluster_id")
    )
    added = known.filter("is_new").select("address", F.col("label").alias("cluster_id")).join(merged, "cluster_id").select(
        "address", F.col("_joined").alias("cluster_id")
    )
    return relabelled.unionByName(added)


def spanning_forest(links: DataFrame, workspace: Workspace) -> DataFrame:
    """(tx_hash, src, dst): the links that hold the clusters together, one fewer than members in each.

    `links` are (tx_hash, src, dst). An edge keeps its least transaction; of all forests this is the one
    with the least edges in the order of (transaction, src, dst), so it is unique, and no cycle of links has
    its greatest one in it. Boruvka's rounds: every cluster so far takes its least edge to another one, the
    taken edges are contracted, edges inside a cluster and all but the least between two clusters are dropped.
    Each round at least halves the clusters that still have edges. Links of an address with itself are none.
    """
    least = links.filter("src <> dst").groupBy("src", "dst").agg(F.min("tx_hash").alias("tx_hash"))
    order = ["tx_hash", "src", "dst"]
    # written before they are used, as the range bounds behind the numbers are sampled
    named = workspace.store(
        least.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("edge", F.monotonically_increasing_id())
    )
    current = workspace.store(named.select("edge", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")))
    taken = []
    while not current.isEmpty():
        ends = current.select(F.explode(F.array("a", "b")).alias("label"), "edge")
        taken.append(workspace.store(ends.groupBy("label").agg(F.min("edge").alias("edge")).select("edge").distinct()))
        chosen = current.join(reshuffled(taken[-1], "edge"), "edge", "left_semi")
        joined = workspace.store(connected_components(chosen.select(F.col("a").alias("src"), F.col("b").alias("dst")), workspace))
        for end in ("a", "b"):
            moved = joined.select(F.col("address").alias(end), F.col("cluster_id").alias("_to"))
            current = current.join(reshuffled(moved, end), end).withColumn(end, F.col("_to")).drop("_to")
        across = current.filter("a <> b").select("edge", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        current = workspace.store(across.groupBy("a", "b").agg(F.min("edge").alias("edge")))
    if not taken:
        return named.select(*order)
    forest = reduce(DataFrame.unionByName, taken)
    return named.join(forest, "edge", "left_semi").select(*order)


def component_links(links: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """The labelled links inside the given clusters (a frame with a `cluster_id` column)."""
    chosen = clusters.join(members.select("cluster_id"), "cluster_id", "left_semi")
    return links.join(chosen.select(F.col("address").alias("src")), "src", "left_semi").select(
        "tx_hash", "src", "dst"
    )
