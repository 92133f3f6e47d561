"""Hard negatives of anchors by angular triangle filtering, with exact integer scores.

A score is the inner product of two whole-number vectors. For vectors a, x and a reference direction r the
angle between a and x is at least the difference and at most the sum of their angles to r. Angles to the
references are stored with every vector, so a wanted range of scores, divided by the norms, becomes a range of
angles to a reference. Rows stand in blocks by their nearest reference, sorted by their angle to it: the
range is a window of the block, found by binary search. Ranges are widened by SLACK against
rounding. A block, and then a row, is scored for an anchor only if the ranges of all references overlap; scores are
exact whole numbers.

1. Index: references are centres of a few rounds of spherical k-means over a sample of SAMPLE rows (the bound
   is a parameter of the index; any references give the same result). Every row is indexed.
2. Home: each anchor meets the rows of its label in its own block; the score of the last place it fills
   there is a bound on its last positive.
3. Positives, then negatives: tiles of row slices and anchor groups meet in one cogroup, so rows are copied
   once for each group of anchors and anchors once for each slice. A tile keeps the best few of each
   anchor (and positive), and the tiles' lists are merged. Tiles have bounded sizes; they are told apart by
   hashes of block and anchor ids, so no label, reference or frequent vector gathers in one task.

The anchors are a stated share of the rows; what is scored grows as anchors x rows, less what the windows leave out.

Defined results: rows with a null id, null label, null vector, or null or non-finite component take no part;
vectors of different length do not meet; "other" rows are those with another id; of several rows with
an anchor's id the anchor is the least one by label and vector, and each is a candidate for other anchors;
equal rows are candidates each; an anchor without positive or without negative gives no row; a vector
of zeros has score 0 with all; an empty table gives no rows; extra columns are ignored. Scores are exact below
2**45 (components up to some 2,000 at 64 dimensions).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspool.workspace import Workspace

SCALE = 256
WANTED = 5
REFERENCES = 16
SAMPLE = 4096
KMEANS_ROUNDS = 5
BLOCK_VALUES = 1 << 18  # whole numbers in a block of rows
BLOCKS_PER_SLICE = 16
ANCHORS_PER_GROUP = 4096
SLACK = 2e-6  # radians; arccos of a rounded cosine is off by less than 1e-7

ROWS = "vec_id long, label long, v array<long>, dim int, ref int, angle double, norm double, angles array<double>"
BLOCK = (
    "block long, dim int, ref int, size int, ids array<long>, labels array<long>, v array<long>, "
    "norms array<double>, angles array<double>, home array<struct<vec_id: long, bound: long>>"
)
FOUND = "anchor_id long, place int, candidate_id long, score long"


def usable(table: DataFrame, label: Column, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    made = table.select(
        F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.col(vector_column).cast("array<double>").alias("x"),
    )
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return made.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite).select(
        "vec_id", "label", F.transform("x", lambda x: F.floor(x * SCALE).cast("long")).alias("v")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    floats = v.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", floats, floats))
    return floats / np.where(norms > 0, norms, 1)[:, None], norms


def references_of(rows: DataFrame, count: int = REFERENCES, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Unit vectors for each length of vectors, from a sample of at most `sample` rows in all."""
    drawn = rows.select(F.size("v").alias("dim"), "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    found = {}
    for dim, part in drawn.groupby("dim"):
        units, norms = _units(np.stack(part["v"].to_numpy()).reshape(len(part), int(dim)))
        units = np.unique(units[norms > 0], axis=0)
        if not len(units):
            continue
        centres = units[np.linspace(0, len(units) - 1, min(count, len(units))).astype(int)]
        for _ in range(KMEANS_ROUNDS):
            nearest = np.argmax(units @ centres.T, axis=1)
            sums = np.stack([units[nearest == k].sum(axis=0) for k in range(len(centres))])
            made, lengths = _units(sums)
            centres = np.where(lengths[:, None] > 0, made, centres)
        found[int(dim)] = centres
    return found


def with_angles(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """ROWS of (vec_id, label, v): angles to all references of their length, and the nearest."""
    known = rows.sparkSession.sparkContext.broadcast(references)  # at most SAMPLE vectors

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(x) for x in batch.column("v")])
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                v = _matrix(part.column("v"), int(dim)) if dim else np.zeros((part.num_rows, 0), dtype=np.int64)
                units, norms = _units(v)
                centres = known.value.get(int(dim), np.zeros((0, dim)))
                cosines = np.clip(units @ centres.T, -1, 1)
                angles = np.arccos(cosines)
                # vectors without a direction, and those of a length the sample lacks, stand apart
                lost = (norms == 0) | (len(centres) == 0)
                nearest = np.where(lost, -1, np.argmin(angles, axis=1) if len(centres) else -1)
                own = np.where(lost, 0.0, angles.min(axis=1) if len(centres) else 0.0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(v) + 1) * len(centres), pa.int32()), pa.array(angles.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), part.column("v"), pa.array(np.full(len(v), dim, np.int32)),
                     pa.array(nearest.astype(np.int32)), pa.array(own), pa.array(norms), lists],
                    names=["vec_id", "label", "v", "dim", "ref", "angle", "norm", "angles"],
                )

    return rows.mapInArrow(measure, ROWS)


def packed(rows: DataFrame, workspace: Workspace, divisor: int, wanted: int = WANTED, block_values: int = BLOCK_VALUES) -> DataFrame:
    """BLOCK of ROWS: at most `block_values` numbers, one length and reference, sorted by angle.

    `home` has the anchors of the block with the score of the last of `wanted` rows of their label there.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, key = [], 0, None
        for batch in batches:
            keys = np.stack([batch.column("dim").to_numpy(), batch.column("ref").to_numpy()], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                here = tuple(int(x) for x in keys[start])
                most = max(1, block_values // max(here[0], 1))
                if key != here and held:
                    yield _block(waiting, key, divisor, wanted)
                    waiting, held = [], 0
                key = here
                while start < end:
                    take = min(end - start, most - held)
                    waiting.append(batch.slice(start, take))
                    start, held = start + take, held + take
                    if held == most:
                        yield _block(waiting, key, divisor, wanted)
                        waiting, held = [], 0
        if held:
            yield _block(waiting, key, divisor, wanted)

    ordered = rows.repartitionByRange("dim", "ref", "angle", "vec_id").sortWithinPartitions("dim", "ref", "angle", "vec_id")
    return workspace.store(ordered.mapInArrow(pack, BLOCK).withColumn("block", F.monotonically_increasing_id()))


def _block(parts: list[pa.RecordBatch], key: tuple[int, int], divisor: int, wanted: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    flat = lambda name: table.column(name).combine_chunks().flatten()
    lists = [table.column("vec_id"), table.column("label"), flat("v"), table.column("norm"), flat("angles")]
    held = [x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.to_numpy() for x in lists]
    size = table.num_rows
    homes = _home_bounds(Block(key[1], held[0], held[1], held[2].reshape(size, -1), held[3], held[4].reshape(size, -1)), divisor, wanted)
    one = [pa.array([0], pa.int64()), pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([size], pa.int32())]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in zip(held, kinds)]
    home = pa.array([homes], pa.list_(pa.struct([("vec_id", pa.int64()), ("bound", pa.int64())])))
    names = ["block", "dim", "ref", "size", "ids", "labels", "v", "norms", "angles", "home"]
    return pa.RecordBatch.from_arrays([*one, *arrays, home], names=names)


@dataclass
class Block:
    """Rows of one length near one reference, sorted by their angle to it."""

    ref: int
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    norms: np.ndarray
    angles: np.ndarray  # rows x references

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, at: int) -> Block:
        held = lambda name: batch.column(name)[at].values.to_numpy(zero_copy_only=False)
        size = batch.column("size")[at].as_py()
        return cls(
            batch.column("ref")[at].as_py(), held("ids"), held("labels"), held("v").reshape(size, -1),
            held("norms"), held("angles").reshape(size, -1),
        )

    def windows(self, norms: np.ndarray, angles: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[start, end) of the rows that can have a score from `least` to `most` with each anchor."""
        size = len(self.ids)
        if self.ref < 0 or not size:
            return np.zeros(len(norms), dtype=np.int64), np.full(len(norms), size, dtype=np.int64)
        low, high = self.norms.min(), self.norms.max()
        with np.errstate(divide="ignore", invalid="ignore"):
            # the smallest cosine that gives `least`, and the greatest that gives no more than `most`
            floor = np.where(least > 0, least / (norms * high), least / (norms * low))
            ceiling = np.where(most > 0, most / (norms * low), most / (norms * high))
        zero = norms == 0
        widest = np.where(zero, np.pi, np.arccos(np.clip(floor, -1, 1))) + SLACK
        widest = np.where(~zero & (floor > 1 + SLACK), -1, widest)
        narrowest = np.where(zero, 0, np.arccos(np.clip(ceiling, -1, 1))) - SLACK
        narrowest = np.where(~zero & (ceiling < -1 - SLACK), 2 * np.pi, narrowest)
        own = self.angles[:, self.ref]
        start = np.searchsorted(own, np.maximum(angles[:, self.ref] - widest, narrowest - angles[:, self.ref]), side="left")
        end = np.searchsorted(own, angles[:, self.ref] + widest, side="right")
        # the block as a whole, seen from every reference; references may be on the far side as well
        nearest, farthest = self.angles.min(axis=0), self.angles.max(axis=0)
        gap = np.maximum(np.maximum(nearest - angles, angles - farthest).max(axis=1), 0)
        reach = np.minimum(angles + farthest, 2 * np.pi - angles - nearest).min(axis=1)
        out = ~zero & ((gap > widest) | (reach < narrowest))
        return np.where(out, 0, start), np.where(out, 0, np.maximum(start, end))

    def scores(self, v: np.ndarray, norms: np.ndarray, start: int, end: int) -> np.ndarray:
        """Whole-number inner products of the anchors with rows `start` to `end`."""
        # sums of whole numbers below 2**53 are exact in doubles, and much faster
        return np.rint(v.astype(np.float64) @ self.v[start:end].astype(np.float64).T).astype(np.int64)


@dataclass
class Anchors:
    """Anchors of one length."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    bounds: np.ndarray  # anchors x places: positives' scores, or one bound

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, dim: int) -> Anchors:
        size = table.num_rows
        numbers = lambda name: np.asarray(table.column(name).to_numpy())
        flat = lambda name: np.concatenate([x.flatten().to_numpy() for x in _chunks(table.column(name))] or [np.empty(0)])
        # fewer positives than WANTED leave the last places empty
        bounds = [x + [None] * (WANTED - len(x)) for x in table.column("bounds").to_pylist()]
        return cls(
            numbers("vec_id"), numbers("label"), flat("v").astype(np.int64).reshape(size, dim), numbers("norm"),
            flat("angles").reshape(size, -1), np.array([[np.nan if b is None else b for b in x] for x in bounds], dtype=np.float64),
        )


def _chunks(column: pa.ChunkedArray | pa.Array) -> list[pa.Array]:
    return column.chunks if isinstance(column, pa.ChunkedArray) else [column]


def _first(keys: tuple[np.ndarray, ...], wanted: int) -> np.ndarray:
    """The first `wanted` of each group: groups by all keys but the last two, which order (score, then id)."""
    *groups, scores, ids = keys
    order = np.lexsort((ids, -scores, *reversed(groups)))
    if not order.size:
        return order
    changed = np.zeros(order.size, dtype=bool)
    changed[0] = True
    for group in groups:
        changed[1:] |= group[order][1:] != group[order][:-1]
    starts = np.maximum.accumulate(np.where(changed, np.arange(order.size), 0))
    return order[np.arange(order.size) - starts < wanted]


def _candidates(anchors: Anchors, block: Block, least: np.ndarray, most: np.ndarray, same_label: bool) -> tuple[np.ndarray, ...]:
    """(anchor, row, score) of the rows of the block with a score from `least` to `most`."""
    start, end = block.windows(anchors.norms, anchors.angles, least, most)
    reached = np.flatnonzero(end > start)
    if not reached.size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = int(start[reached].min()), int(end[reached].max())
    scores = block.scores(anchors.v[reached], anchors.norms[reached], first, last)
    labels = anchors.labels[reached][:, None] == block.labels[None, first:last]
    fits = (labels if same_label else ~labels) & (anchors.ids[reached][:, None] != block.ids[None, first:last])
    fits &= (scores >= least[reached][:, None]) & (scores <= most[reached][:, None])
    anchor, row = np.nonzero(fits)
    return reached[anchor], row + first, scores[anchor, row]


class Best:
    """The best candidates of each (anchor, place), kept over the blocks of a tile."""

    def __init__(self, wanted: int):
        self.wanted = wanted
        self.held = [np.empty(0, np.int64)] * 4  # anchor, place, score, id

    def add(self, anchor: np.ndarray, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        joined = [np.concatenate(pair) for pair in zip(self.held, (anchor, place, score, ids))]
        keep = _first(tuple(joined), self.wanted)
        self.held = [x[keep] for x in joined]

    def worst(self, count: int, places: int) -> np.ndarray:
        """Score of the last of `wanted` candidates, anchors x places; lowest where there are fewer."""
        found = np.full((count, places), -np.inf)
        anchor, place, score, _ = self.held
        slot = anchor * places + place
        sizes = np.bincount(slot, minlength=count * places)
        lowest = np.full(count * places, np.inf)
        np.minimum.at(lowest, slot, score.astype(np.float64))
        full = sizes >= self.wanted
        found.ravel()[full] = lowest[full]
        return found

    def table(self, ids: np.ndarray) -> pa.Table:
        anchor, place, score, candidate = self.held
        return pa.table({
            "anchor_id": pa.array(ids[anchor], pa.int64()), "place": pa.array(place.astype(np.int32)),
            "candidate_id": pa.array(candidate, pa.int64()), "score": pa.array(score, pa.int64()),
        })


def _positives_in(anchors: Anchors, blocks: Iterator[Block], wanted: int) -> pa.Table:
    best, most = Best(wanted), np.full(len(anchors.ids), np.inf)
    for block in blocks:
        least = np.fmax(anchors.bounds[:, 0], best.worst(len(anchors.ids), 1)[:, 0])
        anchor, row, score = _candidates(anchors, block, least, most, same_label=True)
        best.add(anchor, np.zeros_like(anchor), score, block.ids[row])
    return best.table(anchors.ids)


def _negatives_in(anchors: Anchors, blocks: Iterator[Block], wanted: int, percent: tuple[int, int]) -> pa.Table:
    """`bounds` are the scores of the positives; a negative fits from percent[0] to percent[1] of them."""
    best, places = Best(wanted), anchors.bounds.shape[1]
    least, most = _range_of(anchors.bounds, percent)
    for block in blocks:
        floors = np.fmax(least, best.worst(len(anchors.ids), places))
        floors = np.where(np.isnan(least), np.inf, floors)
        anchor, row, score = _candidates(
            anchors, block, floors.min(axis=1), np.where(np.isnan(most), -np.inf, most).max(axis=1), same_label=False
        )
        for place in range(places):
            fits = (score >= floors[anchor, place]) & (score <= most[anchor, place])
            chosen = anchor[fits]
            best.add(chosen, np.full_like(chosen, place), score[fits], block.ids[row[fits]])
    return best.table(anchors.ids)


def _range_of(positive: np.ndarray, percent: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score s with percent[0] p <= 100 s <= percent[1] p."""
    return np.ceil(percent[0] * positive / 100), np.floor(percent[1] * positive / 100)


def _tiles(blocks: DataFrame, anchors: DataFrame, slices: int, groups: int, per_tile, settings: tuple) -> DataFrame:
    """FOUND of every anchor with every block, in tiles of a slice of blocks and a group of anchors."""
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = blocks.drop("home").withColumns({"slice": F.pmod(F.xxhash64("block"), F.lit(slices)), "group": every(groups)})
    right = anchors.withColumns({"group": F.pmod(F.xxhash64("vec_id"), F.lit(groups)), "slice": every(slices)})

    def meet(rows: pa.Table, some: pa.Table) -> pa.Table:
        made = [pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("candidate_id", pa.int64()), ("score", pa.int64())]).empty_table()]
        dims = rows.column("dim").to_numpy()
        own = some.column("dim").to_numpy()
        for dim in np.intersect1d(np.unique(dims), np.unique(own)):
            chosen = Anchors.of(some.filter(pa.array(own == dim)), int(dim))
            made.append(per_tile(chosen, (Block.of(rows, int(at)) for at in np.flatnonzero(dims == dim)), *settings))
        return pa.concat_tables(made)

    return left.groupBy("slice", "group").cogroup(right.groupBy("slice", "group")).applyInArrow(meet, FOUND)


def _home_bounds(block: Block, divisor: int, wanted: int) -> list[dict]:
    own = np.flatnonzero(block.ids % divisor == 0)
    found = []
    for part in range(0, len(own), 256):
        at = own[part : part + 256]
        infinite = np.full(len(at), np.inf)
        some = Anchors(block.ids[at], block.labels[at], block.v[at], block.norms[at], block.angles[at], -infinite[:, None])
        anchor, row, score = _candidates(some, block, -infinite, infinite, same_label=True)
        best = Best(wanted)
        best.add(anchor, np.zeros_like(anchor), score, block.ids[row])
        worst = best.worst(len(at), 1)[:, 0]
        found += [{"vec_id": int(i), "bound": int(w)} for i, w in zip(some.ids, worst) if w > -np.inf]
    return found


def _best_of(found: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    """The first `wanted` candidates of each key as an array `best` of (down, candidate_id); down is less the score."""
    # at most `wanted` from each tile
    return found.groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "candidate_id"))), 1, wanted).alias("best")
    )


def hard_negatives(table: DataFrame, workspace: Workspace, label: Column, anchor_divisor: int = 100, wanted: int = WANTED,
                   percent: tuple[int, int] = (80, 100), id_column: str = "vec_id", vector_column: str = "embedding",
                   block_values: int = BLOCK_VALUES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `anchor_divisor`, positives the first `wanted` others of their
    label, negatives the first `wanted` of other labels with a score within `percent` of the positive's.
    """
    clean = workspace.store(usable(table, label, id_column, vector_column))
    rows = workspace.store(with_angles(clean, references_of(clean)))
    blocks = packed(rows, workspace, anchor_divisor, wanted, block_values)
    slices = max(1, -(-blocks.count() // BLOCKS_PER_SLICE))
    chosen = rows.filter(F.col("vec_id") % anchor_divisor == 0).groupBy("vec_id").agg(
        F.min(F.struct("label", "v", "dim", "norm", "angles")).alias("a"), F.count("*").alias("rows")
    )
    homes = blocks.select(F.inline("home")).groupBy("vec_id").agg(F.min("bound").alias("bound"))
    # of an id with several rows it is not known whose bound it is
    bounds = F.array(F.when(F.col("rows") == 1, F.col("bound")))
    anchors = workspace.store(
        chosen.join(homes, "vec_id", "left").select("vec_id", "a.*", bounds.alias("bounds"))
    )
    size = anchors.count()
    groups = max(1, -(-size // min(ANCHORS_PER_GROUP, max(64, size // 16))))
    positives = workspace.store(
        _best_of(_tiles(blocks, anchors, slices, groups, _positives_in, (wanted,)), ["anchor_id"], wanted)
    )
    measured = anchors.drop("bounds").join(
        positives.select(F.col("anchor_id").alias("vec_id"), F.transform("best", lambda b: -b["down"]).alias("bounds")), "vec_id"
    )
    found = _best_of(
        _tiles(blocks, workspace.store(measured), slices, groups, _negatives_in, (wanted, percent)), ["anchor_id", "place"], wanted
    ).select("anchor_id", "place", F.posexplode("best").alias("at", "negative"))
    chosen = positives.select("anchor_id", F.posexplode("best").alias("place", "positive"))
    return found.join(chosen, ["anchor_id", "place"]).select(
        "anchor_id", F.col("positive.candidate_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("negative.candidate_id").alias("negative_id"), (-F.col("positive.down")).alias("positive_score"),
        (-F.col("negative.down")).alias("negative_score"),
    )
