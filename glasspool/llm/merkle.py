"""Manifest of a dataset as a Merkle tree per source and one over the sources, by butterfly exchange.

Leaves stand in partitions of FANOUT**LOCAL_LEVELS places of their source, aligned, so each partition holds a
whole subtree and hashes it alone. Then partitions exchange: in round k, FANOUT partitions whose numbers
differ in digit k only (base FANOUT) swap the roots they have reached, and each hashes the parent from all
of them. Siblings hash the same parent redundantly, and what a partition has received by the last round is the
upper part of its leaves' proofs, so nothing is sent down. A round is one shuffle of a row per partition;
there are log16(rows / 4096) rounds. Where the last subtree of a level has fewer partitions than its
siblings, its partitions send their root also in the place of those it lacks, at most as many rows as the
level has partitions.

The subroots of the sources are leaves of one more tree, made in the same way. Proofs come from a last
pass in which each partition meets its one row of upper levels.

Places are numbered over ranges of (source, id), so a source with a third of all rows is spread; a task
holds one partition of 4096 digests, never texts. Digests of rows are made by Spark.

Defined results: null fields are `-`; null sources are one source, first; rows with a null id come
first in their source; rows of equal id are ordered by leaf, repeated rows are leaves each; empty texts are
`0:`; an empty table gives no rows; the id is null or a whole number; rows with a null id are never tampered;
columns other than the five are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasspool.operators.positions import numbered
from glasspool.workspace import Workspace

FANOUT = 16
BITS = 4  # of one digit
LOCAL_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: of each level above a partition, the nodes of its run before and after its own
_STEPS = "array<struct<before: string, after: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """H of the values, each with its number of bytes before it."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, divisor: int, workspace: Workspace, local_levels: int = LOCAL_LEVELS) -> DataFrame:
    """(tree, place, block, doc_id, node, tampered): `tampered` is null for rows left alone."""
    doc_id, source, lang, n_chars, text = (F.col(name) for name in FIELDS)
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % divisor == 0
    made = docs.select(
        F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit("")).alias("tree"),
        doc_id.cast("long").alias("doc_id"),
        leaf_digest(doc_id, source, lang, n_chars, text).alias("node"),
        F.when(chosen, leaf_digest(doc_id, source, lang, n_chars, F.translate(text.cast("string"), _UPPER, _LOWER))).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    # written first, as the range partitioning samples it
    placed = numbered(workspace.store(made), ["tree"], ["doc_id", "node", "row"], "place", workspace)
    return workspace.store(_blocked(placed, local_levels))


def _blocked(nodes: DataFrame, local_levels: int) -> DataFrame:
    return nodes.drop("row").withColumn("block", F.shiftright("place", BITS * local_levels))


def _levels(block: int, nodes: list[str], local_levels: int) -> list[list[str]]:
    """The nodes of each level of a partition, leaves first. Only a first partition can be a whole tree;
    then it stops at its root, while others always rise `local_levels`."""
    alone = block == 0 and len(nodes) < FANOUT**local_levels
    found = [nodes]
    while len(found) <= local_levels and not (alone and len(found[-1]) == 1):
        below = found[-1]
        found.append([digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return found


def _sorted_nodes(table: pa.Table, *columns: str) -> list[list]:
    ordered = table.sort_by("place")
    return [ordered.column(name).to_pylist() for name in columns]


def subtree_roots(nodes: DataFrame, local_levels: int = LOCAL_LEVELS) -> DataFrame:
    """(tree, block, root) of each partition of nodes (tree, place, block, node)."""

    def climb(key: tuple, table: pa.Table) -> pa.Table:
        (held,) = _sorted_nodes(table, "node")
        root = _levels(key[1].as_py(), held, local_levels)[-1][0]
        return pa.table({"tree": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int64()), "root": [root]})

    return nodes.select("tree", "block", "place", "node").groupBy("tree", "block").applyInArrow(
        climb, "tree string, block long, root string"
    )


def _exchanged(state: DataFrame, turn: int) -> DataFrame:
    """One round of (tree, block, blocks, root, steps); trees with one node at this level stay."""
    low = 1 << (BITS * turn)  # partitions below a node of this level
    node = F.shiftright("block", BITS * turn)
    group, mine = F.shiftright("block", BITS * (turn + 1)), F.shiftright("block", BITS * turn).bitwiseAND(FANOUT - 1)
    lane = F.col("block").bitwiseAND(low - 1)
    last = F.shiftright(F.col("blocks") - 1, BITS * turn)
    short = F.col("blocks") - last * low  # partitions of the last node
    # partitions of a last node that is not full also send in the lanes it lacks
    lanes = F.when((node == last) & (last > 0), F.sequence(lane, F.lit(low - 1).cast("long"), short)).otherwise(F.array(lane))
    sent = state.withColumns({"group": group, "digit": mine, "own_lane": lane, "last": last, "lane": F.explode(lanes)})
    meeting = Window.partitionBy("tree", "group", "lane")
    met = F.array_sort(F.collect_list(F.struct("digit", "root")).over(meeting))
    roots = lambda keep: F.concat_ws("", F.transform(F.filter("met", keep), lambda x: x["root"]))
    step = F.struct(roots(lambda x: x["digit"] < F.col("digit")).alias("before"), roots(lambda x: x["digit"] > F.col("digit")).alias("after"))
    rises = F.col("last") > 0
    return (
        sent.withColumn("met", met)
        .filter(F.col("lane") == F.col("own_lane"))
        .select(
            "tree", "block", "blocks",
            F.when(rises, F.sha2(roots(lambda x: F.lit(True)).cast("binary"), 256)).otherwise(F.col("root")).alias("root"),
            F.when(rises, F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"),
        )
    )


def butterfly(roots: DataFrame, workspace: Workspace) -> DataFrame:
    """(tree, block, root, steps): the root of the whole tree, and the steps from the partition up to it."""
    stored = workspace.store(roots)
    sizes = stored.groupBy("tree").agg((F.max("block") + 1).alias("blocks"))
    state = stored.join(sizes, "tree").withColumn("steps", F.array().cast(_STEPS)).select("tree", "block", "blocks", "root", "steps")
    most = stored.agg(F.max("block")).first()[0]
    turn = 0
    while most is not None and most >> (BITS * turn):
        state = workspace.store(_exchanged(state, turn))
        turn += 1
    return state.drop("blocks")


def _steps_of(levels: list[list[str]], place: int) -> Iterator[tuple[str, str]]:
    """Nodes before and after the own node, in the run of each level of a partition."""
    for nodes in levels[:-1]:
        run = place - place % FANOUT
        yield "".join(nodes[run:place]), "".join(nodes[place + 1 : run + FANOUT])
        place //= FANOUT


def proved(nodes: DataFrame, uppers: DataFrame, local_levels: int = LOCAL_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf, `uppers` being
    (tree, block, subroot, root, steps) with all steps from the partition up."""

    def prove(key: tuple, held: pa.Table, upper: pa.Table) -> pa.Table:
        ids, own, tampered = _sorted_nodes(held, "doc_id", "node", "tampered")
        levels = _levels(key[1].as_py(), own, local_levels)
        above = upper.to_pylist()[0]
        steps_above = [(s["before"], s["after"]) for s in above["steps"]]
        end = "".join(before + after for before, after in steps_above)
        proofs, folded = [], []
        for place, leaf in enumerate(own):
            steps = list(_steps_of(levels, place))
            proofs.append(digest("".join(before + after for before, after in steps) + end))
            node = tampered[place] or leaf
            for before, after in (*steps, *steps_above):
                node = digest(before + node + after)
            folded.append(node)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "leaf": own, "subroot": [above["subroot"]] * len(own), "root": [above["root"]] * len(own),
            "proof_sha256": proofs, "folded_root": folded, "verified": [node == above["root"] for node in folded],
        })

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return nodes.groupBy("tree", "block").cogroup(uppers.groupBy("tree", "block")).applyInArrow(prove, schema)


def source_steps(subroots: DataFrame, workspace: Workspace, local_levels: int = LOCAL_LEVELS) -> DataFrame:
    """(tree, subroot, root, over): of each source (tree, subroot) its steps to the root of all."""
    # one row per source; the tree over sources is called by a constant
    ordered = numbered(
        subroots.select(F.col("tree").alias("source"), F.col("subroot").alias("node"), F.lit("").alias("tree")),
        ["tree"], ["source"], "place", workspace,
    )
    nodes = workspace.store(_blocked(ordered, local_levels))
    uppers = butterfly(subtree_roots(nodes, local_levels), workspace)

    def climb(key: tuple, held: pa.Table, upper: pa.Table) -> pa.Table:
        sources, own = _sorted_nodes(held, "source", "node")
        levels = _levels(key[1].as_py(), own, local_levels)
        above = upper.to_pylist()[0]
        steps = [
            [{"before": b, "after": a} for b, a in _steps_of(levels, place)] + above["steps"] for place in range(len(own))
        ]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table({"tree": sources, "subroot": own, "root": [above["root"]] * len(own), "over": pa.array(steps, kind)})

    return nodes.groupBy("tree", "block").cogroup(uppers.groupBy("tree", "block")).applyInArrow(
        climb, f"tree string, subroot string, root string, over {_STEPS}"
    )


def manifest(docs: DataFrame, workspace: Workspace, divisor: int = 5, local_levels: int = LOCAL_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per document.

    `docs` has the columns FIELDS. Rows whose crc32 of the id is divisible by `divisor` are checked with
    their text's A-Z in lower case, all others as they are. A partition has FANOUT**local_levels leaves.
    """
    nodes = leaves(docs, divisor, workspace, local_levels)
    climbed = butterfly(subtree_roots(nodes, local_levels), workspace)
    subroots = climbed.filter("block = 0").select("tree", F.col("root").alias("subroot"))
    sources = source_steps(subroots, workspace, local_levels)
    uppers = climbed.drop("root").join(sources, "tree").select(
        "tree", "block", "subroot", "root", F.concat("steps", "over").alias("steps")
    )
    return proved(nodes, workspace.store(uppers), local_levels)
