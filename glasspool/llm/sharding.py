"""Shards of near equal bytes: a minimax contiguous partition of the texts in hash order.

Rows of equal text are one atomic group. Groups stand in the order of a 64-bit hash of their text, so
a shard is a range of hashes and a row finds its shard by comparing its hash with the cuts. The
smallest capacity for which a greedy walk over the groups fills no more than the wanted shards is
found by binary search; a group larger than the capacity is a shard of its own, so one hot group does
not widen the others. (The greatest shard, the larger of the capacity and the greatest group, is then as
small as any contiguous partition can make it. A partition valid for a capacity is valid for each
greater one, and a part of a valid shard is valid, which is why the greedy check and the search hold.)

The groups are not collected. Their sizes are summed up in range partitions; the driver sees only some
positions at which groups start: the first and the last start in each of at most CELLS cells of equal
bytes. Between such positions the greedy walk is bounded from below and above, which bounds the
capacity and each cut. Only the windows where cuts can be are read again, in finer cells, until
capacity and cuts are exact. Each turn narrows the windows by more than an order of magnitude.

Two shuffles of narrow rows (groups, and rows for their slots) whatever the number of shards, none of
texts. A group of any number of rows is summed by partial aggregation, and its rows are numbered over as
many tasks as they fill.

Defined results: a null text counts as empty and shares the group of empty texts, with 8 bytes a row;
rows with a null id and repeated rows are rows like others, each with a slot; of ties in a group the
lesser id stands first, null ids before all; two texts with the same 64-bit hash share a group; with
fewer groups than shards, or no rows, the last shards are empty; extra columns are ignored by
`shard_rows` and kept by `write_shards`, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasspool.llm.text import documents, fresh_name
from glasspool.operators.positions import numbered
from glasspool.workspace import Workspace

SHARDS = 24
ROW_BYTES = 8
CELLS = 1 << 16
_PART_BITS = 1 << 33  # rows in a partition, fixed by monotonically_increasing_id


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _size(text: Column) -> Column:
    return (F.octet_length(text) + ROW_BYTES).cast("long")


def group_starts(groups: DataFrame, workspace: Workspace) -> DataFrame:
    """(key, bytes, start): the bytes of all groups with a smaller key, of (key, bytes)."""
    ordered = groups.repartitionByRange("key").sortWithinPartitions("key")
    placed = workspace.store(
        ordered.select("key", "bytes", F.floor(F.monotonically_increasing_id() / _PART_BITS).alias("part"))
    )
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.sum("bytes").alias("held")).select(
        "part", F.coalesce(F.sum("held").over(before(Window.orderBy("part"))), F.lit(0)).alias("offset")
    )
    inside = F.coalesce(F.sum("bytes").over(before(Window.partitionBy("part").orderBy("key"))), F.lit(0))
    return workspace.store(
        placed.withColumn("inside", inside).join(offsets, "part").select("key", "bytes", (F.col("inside") + F.col("offset")).alias("start"))
    )


@dataclass
class Outline:
    """Known starts of groups, in order, the end of all last; `open_after` says whether groups that are
    not known may start between a position and the next."""

    positions: list[int]
    open_after: list[bool]

    def least_end(self, start: int, capacity: int) -> int:
        """No more than where a greedy shard from `start`, a known position, ends."""
        at = bisect_right(self.positions, start + capacity) - 1
        if self.positions[at] > start:
            return self.positions[at]
        return start if self.open_after[at] else self.positions[at + 1]

    def greatest_end(self, start: int, capacity: int) -> int:
        """No less than where a greedy shard from `start` ends."""
        top = start + capacity
        at = bisect_right(self.positions, top) - 1
        if at + 1 == len(self.positions):
            return self.positions[-1]
        following = bisect_right(self.positions, start)
        if following > at:  # nothing known to start within reach
            return self.positions[following]
        return top if self.open_after[at] else self.positions[at]

    def cuts(self, capacity: int, shards: int, upper: bool) -> list[int]:
        """Bounds of the ends of the first `shards` shards."""
        ends, end, total = [], self.positions[0], self.positions[-1]
        step = self.greatest_end if upper else self.least_end
        for _ in range(shards):
            end = step(end, capacity) if end < total else total
            ends.append(end)
        return ends

    def smallest(self, shards: int, upper: bool) -> int:
        """The smallest capacity with which the bounds of the ends reach the end of all."""
        low, high = 1, max(self.positions[-1] - self.positions[0], 1)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, upper)[-1] == self.positions[-1]:
                high = middle
            else:
                low = middle + 1
        return low

    def refined(self, windows: list[tuple[int, int]], cells: list[tuple[int, int, int]]) -> Outline:
        """With what the windows, which start and end at known positions, hold in finer cells (first, last, groups)."""
        found = {}
        for position, is_open in zip(self.positions, self.open_after + [False]):
            if not any(low <= position < high for low, high in windows):
                found[position] = is_open
        for first, last, groups in cells:
            found[first] = groups > 2
            if last > first:
                found[last] = False
        positions = sorted(found)
        return Outline(positions, [found[p] for p in positions[:-1]])


def _windows(outline: Outline, lows: list[int], highs: list[int]) -> list[tuple[int, int]]:
    """Ranges between known positions that hold every cut, those that meet joined."""
    joined: list[tuple[int, int]] = []
    for low, high in zip(lows, highs):
        if low == high:
            continue
        window = (
            outline.positions[bisect_right(outline.positions, low) - 1],
            outline.positions[bisect_left(outline.positions, high)],
        )
        if joined and window[0] <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(joined[-1][1], window[1]))
        else:
            joined.append(window)
    return joined


def _cells(starts: DataFrame, windows: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """(first start, last start, groups) of each cell of `width` bytes within the windows."""
    inside = F.lit(False)
    for low, high in windows:
        inside = inside | F.col("start").between(low, high - 1)
    window = sum((F.when(F.col("start") >= low, 1).otherwise(0) for low, _ in windows), F.lit(0))
    cell = F.col("start") - F.col("start") % width
    found = starts.filter(inside).groupBy(window.alias("window"), cell.alias("cell")).agg(
        F.min("start"), F.max("start"), F.count("*")
    )
    return [tuple(row)[2:] for row in found.collect()]


def minimax_cuts(starts: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> list[int]:
    """Where the shards after the first start, of a result of `group_starts`."""
    total = starts.agg(F.max(F.col("start") + F.col("bytes"))).first()[0]
    if total is None:
        return []
    windows, width = [(0, total)], -(-total // cells)
    outline = Outline([0, total], [True])
    while True:
        outline = outline.refined(windows, _cells(starts, windows, width))
        low, high = outline.smallest(shards, upper=True), outline.smallest(shards, upper=False)
        lows, highs = outline.cuts(low, shards, upper=False), outline.cuts(high, shards, upper=True)
        windows = _windows(outline, lows, highs)
        if not windows:
            return [cut for cut in sorted(set(lows)) if cut < total]
        width = max(1, min(width // 2, -(-sum(b - a for a, b in windows) // cells)))


def cut_keys(groups: DataFrame, workspace: Workspace, shards: int = SHARDS, cells: int = CELLS) -> list[int]:
    """Least key of each shard but the first, of (key, bytes)."""
    starts = group_starts(groups, workspace)
    cuts = minimax_cuts(starts, shards, cells)
    return sorted(row[0] for row in starts.filter(F.col("start").isin(cuts)).select("key").collect()) if cuts else []


def _shard(key: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below the key."""
    return sum((F.when(key >= F.lit(cut).cast("long"), 1).otherwise(0) for cut in cuts), F.lit(0)).cast("int")


def shard_rows(docs: DataFrame, workspace: Workspace, shards: int = SHARDS,
               id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document."""
    whole = documents(docs, id_column=id_column, text_column=text_column).withColumn("text", _text("text"))
    rows = workspace.store(
        whole.select(
            "doc_id", _size(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            _key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("row"),
        )
    )
    cuts = cut_keys(rows.groupBy("key").agg(F.sum("size").alias("bytes")), workspace, shards)
    placed = rows.withColumn("shard", _shard(F.col("key"), cuts))
    return numbered(placed, ["shard"], ["key", "doc_id", "row"], "slot", workspace).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, workspace: Workspace, shards: int = SHARDS,
                 id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write all columns of `docs` as Parquet below path/shard=N, rows in the order of their slots.

    A shard is written by as many tasks as its rows fill.
    """
    text, shard, key = _text(text_column), fresh_name(docs, "shard"), fresh_name(docs, "_key")
    keyed = docs.withColumn(key, _key(text))
    cuts = cut_keys(keyed.groupBy(F.col(key).alias("key")).agg(F.sum(_size(text)).alias("bytes")), workspace, shards)
    order = [shard, key, id_column]
    placed = keyed.withColumn(shard, _shard(F.col(key), cuts)).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.drop(key).write.partitionBy(shard).parquet(path)
