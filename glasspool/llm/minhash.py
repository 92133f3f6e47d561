"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

Min-max hashing (Ji, Li, Yan, Tian and Zhang, 2013) keeps the least *and* the greatest value of a
set under each permutation, so BANDS * ROWS signature values need half as many permutations. At the
default 20 bands of 5 values a pair of similarity 0.85 shares no band with probability 8e-6, one of
similarity 0.8 with probability 4e-4 (`bands_for` gives more bands to lower thresholds).

1. Each text becomes its set of shingle hashes; texts with the same set are one class, represented
   by the least id. A signature is 8 bytes for each band.
2. Classes that share a band lie in one family: links from the least class of each band bucket to
   the others (never all pairs), then connected components.
3. A family is dealt to blocks of bounded size. A family beyond one block is cut by set size
   (a factor of the threshold per slice) and by hash, and only blocks of the same and of the next
   slice meet. A task gets the texts of one pair of blocks, takes the pairs that share a band,
   and confirms them on the full sets; pairs that earlier links of the task connect already need no
   check. It returns at most one edge per text.
4. Components of the confirmed edges, then of all rows through their class.

No pair of different texts that shares a band is lost, whatever the size of a bucket or family, and
no group meets in one task.

Defined results: null, empty and blank texts have no shingles, no links, and are kept; with fewer
words than a shingle, the whole sequence is one shingle; the least id of a component stays; rows
equal in id and text are one document; a null id is linked with nothing and kept; extra columns are carried
along by `drop_near_copies`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.llm.bloom import tried
from glasspool.llm.components import components
from glasspool.llm.text import documents, mix, texts_of, window_hashes, word_hashes
from glasspool.operators.joins import reshuffled
from glasspool.workspace import Workspace

ROWS = 5
MISS = 1e-5
BLOCK_TEXTS = 200
BLOCK_SHINGLES = 200_000
SEED = 20130610

SIGNED = "doc_id long, n_shingles long, class_a long, class_b long, bands array<long>"


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """An even number of bands that a pair at the threshold fails to share with probability `miss`."""
    bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
    return bands + bands % 2


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z in lower case."""
    return np.unique(window_hashes(word_hashes(text.lower()), width))


class Signer:
    """Band hashes of shingle sets under fixed permutations."""

    def __init__(self, bands: int, rows: int = ROWS):
        random = np.random.default_rng(SEED)
        permutations = bands * rows // 2
        self.factor = random.integers(1, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offset = random.integers(0, 2**63, permutations, dtype=np.uint64)
        # the two values of one permutation never meet in a band
        self.order = np.arange(bands * rows).reshape(bands, rows)

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.factor.size, np.iinfo(np.uint64).max, dtype=np.uint64)
        most = np.zeros(self.factor.size, dtype=np.uint64)
        for start in range(0, shingles.size, 2048):
            part = shingles[start : start + 2048] * self.factor[:, None]
            part += self.offset[:, None]
            # multiplication leaves low bits weak; the order is by the high ones
            np.minimum(least, part.min(axis=1), out=least)
            np.maximum(most, part.max(axis=1), out=most)
        values = np.concatenate([least, most])[self.order]
        total = np.arange(len(values), dtype=np.uint64)
        for k in range(values.shape[1]):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
        return total.view(np.int64)


def _signed(docs: DataFrame, width: int, bands: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands)
        for batch in batches:
            sizes, classes_a, classes_b, signatures = [], [], [], []
            for text in texts_of(batch):
                shingles = shingle_set(text, width)
                sizes.append(shingles.size)
                # two independent sums name the set: 128 bits
                classes_a.append(int(mix(shingles).sum(dtype=np.uint64).view(np.int64)))
                classes_b.append(int(mix(shingles ^ np.uint64(SEED)).sum(dtype=np.uint64).view(np.int64)))
                signatures.append(signer.bands(shingles) if shingles.size else [])
            ids = batch.column("doc_id").cast(pa.int64())
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(classes_a, pa.int64()), pa.array(classes_b, pa.int64()),
                       pa.array(signatures, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class_a", "class_b", "bands"])

    return docs.mapInArrow(sign, SIGNED)


def _classes(signed: DataFrame) -> DataFrame:
    """(class, class_a, class_b, n_shingles, bands): the class is the least id with that set."""
    return (
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("class_a", "class_b")
        .agg(F.min("doc_id").alias("class"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    )


def _families(classes: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, component): classes that share bands, directly or through others."""
    placed = classes.select("class", F.posexplode("bands").alias("band", "value"))
    placed = placed.select("class", F.xxhash64("band", "value").alias("bucket"))
    least = placed.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("most"))
    # buckets of one class, nearly all of them, end here
    shared = least.filter("a < most").select("bucket", "a").transform(reshuffled, "bucket")
    return components(placed.join(shared, "bucket").select("a", F.col("class").alias("b")).distinct(), workspace)


def _blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(class, group, side) of `members` (class, family, n_shingles): the groups each class meets others in.

    A group is a pair of blocks of one family; `side` is 0 or 1 for the two.
    """
    weight = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long")
    # sets that can be linked are in the same or in neighbouring slices
    size_slice = F.floor(F.log("n_shingles") / -math.log(threshold)).cast("long")
    slices = members.groupBy("family", size_slice.alias("slice")).agg(
        weight.alias("blocks"), F.count("*").alias("texts"), F.sum("n_shingles").alias("shingles")
    )
    # a family has at most some 150 slices: they are powers of the threshold
    families = slices.groupBy("family").agg(
        F.map_from_entries(F.collect_list(F.struct("slice", "blocks"))).alias("blocks"),
        ((F.sum("texts") <= BLOCK_TEXTS) & (F.sum("shingles") <= BLOCK_SHINGLES)).alias("small"),
    )
    one = F.create_map(F.lit(0).cast("long"), F.lit(1).cast("long"))
    joined = members.join(reshuffled(families, "family"), "family").select(
        "class",
        "family",
        F.when(F.col("small"), 0).otherwise(size_slice).cast("long").alias("slice"),
        F.when(F.col("small"), one).otherwise(F.col("blocks")).alias("blocks"),
    )
    here = F.col("slice")
    mine = F.pmod(F.xxhash64("class"), F.try_element_at("blocks", here))

    def with_slice(other, low_slice, high_slice, low, high, side):
        """Groups with each block of slice `other`; none if the family has no such slice."""
        count = F.coalesce(F.try_element_at("blocks", other), F.lit(0).cast("long"))
        every = F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0).cast("long")))
        group = lambda b: F.struct(
            F.xxhash64("family", low_slice, low(b), high_slice, high(b)).alias("group"), side(b).alias("side")
        )
        return F.when(count > 0, F.transform(every, group)).otherwise(
            F.array().cast("array<struct<group:bigint,side:int>>")
        )

    own = with_slice(here, here, here, lambda b: F.least(mine, b), lambda b: F.greatest(mine, b),
                     lambda b: (mine > b).cast("int"))
    up = with_slice(here + 1, here, here + 1, lambda b: mine, lambda b: b, lambda b: F.lit(0))
    down = with_slice(here - 1, here - 1, here, lambda b: b, lambda b: mine, lambda b: F.lit(1))
    return joined.select("class", F.explode(F.concat(own, up, down)).alias("meet")).select(
        "class", "meet.group", "meet.side"
    )


def _confirm(width: int, bands: int, percent: int):
    def confirm(items: pd.DataFrame) -> pd.DataFrame:
        """Edges (a, b) of a spanning forest of the confirmed links between the texts of a group."""
        items = items.drop_duplicates("class").sort_values("class")
        signer = Signer(bands)
        sets = [shingle_set(text.encode(), width) for text in items["text"]]
        signs = np.array([signer.bands(s) for s in sets])
        ids, sides = items["class"].to_numpy(), items["side"].to_numpy()
        alone = (sides == sides[0]).all()
        sizes = np.array([s.size for s in sets])
        parent = list(range(len(sets)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        edges = []
        for i in range(len(sets) - 1):
            shared = (signs[i + 1 :] == signs[i]).sum(axis=1)
            least, most = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
            fit = (shared > 0) & (100 * least >= percent * most)
            if not alone:
                fit &= sides[i + 1 :] != sides[i]
            for j in (np.flatnonzero(fit) + i + 1).tolist():
                a, b = root(i), root(j)
                if a == b:
                    continue
                both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    parent[b] = a
                    edges.append((ids[i], ids[j]))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return confirm


def near_groups(docs: DataFrame, workspace: Workspace, width: int = 5, percent: int = 80,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document.

    Documents are linked if 100 * intersection >= percent * union of their sets of `width`-word
    shingles; the component id is the least id reachable.
    """
    bands = bands_for(percent / 100)
    narrow = documents(docs, id_column=id_column, text_column=text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = workspace.store(_signed(narrow, width, bands))
    classes = _classes(signed)
    families = workspace.store(_families(classes, workspace))
    members = classes.select("class", "n_shingles").join(
        families.select(F.col("node").alias("class"), F.col("component").alias("family")), "class"
    )
    members = workspace.store(members)
    meets = workspace.store(_blocks(members, percent / 100))
    # a Bloom filter of the members keeps most other texts out of the shuffle
    texts = tried(narrow, F.col("doc_id"), members, F.col("class")).filter("maybe")
    grouped = meets.join(texts.select(F.col("key").alias("class"), "row.text"), "class")
    edges = grouped.groupBy("group").applyInPandas(_confirm(width, bands, percent), "a long, b long")
    linked = components(workspace.store(edges.distinct()), workspace)
    named = (
        classes.select("class_a", "class_b", "class")
        .join(linked.select(F.col("node").alias("class"), "component"), "class", "left")
        .select(_set_key(), F.coalesce("component", "class").alias("component"))
    )
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    alone = F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))  # meets no key, lies in no one partition
    return (
        signed.select("doc_id", "n_shingles", F.when(linkable, _set_key()).otherwise(alone).alias("set_key"))
        .join(reshuffled(named, "set_key"), "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _set_key():
    return F.concat_ws(":", F.col("class_a").cast("string"), F.col("class_b").cast("string")).alias("set_key")


def drop_near_copies(docs: DataFrame, workspace: Workspace, width: int = 5, percent: int = 80,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    groups = near_groups(docs, workspace, width, percent, id_column, text_column)
    gone = workspace.store(groups.filter(~F.col("kept")).select(F.col("doc_id").alias("gone")))
    rows = tried(docs, F.col(id_column).cast("long"), gone, F.col("gone"))
    left = rows.filter("maybe").join(gone, F.col("key") == F.col("gone"), "left_anti")
    return rows.filter(~F.col("maybe")).unionByName(left).select("row.*")
