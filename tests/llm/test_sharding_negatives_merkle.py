import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspool.llm import merkle, negatives, sharding
from tests.llm.conftest import odd_rows

# ---------------------------------------------------------------- shards


def greedy(sizes, capacity):
    """Where shards start: as much as the capacity holds, or one group."""
    starts, held, at = [], None, 0
    for size in sizes:
        if held is None or held + size > capacity:
            starts.append(at)
            held = 0
        held += size
        at += size
    return starts


def best_cuts(sizes, shards):
    """Cuts for the smallest capacity, by trying one after the other where the number of shards can change."""
    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if len(greedy(sizes, middle)) <= shards else (middle + 1, high)
    assert low == 1 or len(greedy(sizes, low - 1)) > shards
    return greedy(sizes, low)[1:]


def cells_of(sizes):
    starts = [0]
    for size in sizes[:-1]:
        starts.append(starts[-1] + size)

    def cells(_, windows, width):
        found = defaultdict(list)
        for start in starts:
            for number, (low, high) in enumerate(windows):
                if low <= start < high:
                    found[number, start // width].append(start)
        return [(min(held), max(held), len(held)) for held in found.values()]

    return cells


class Total:
    """Stands for a frame of group starts where only the end of all is asked."""

    def __init__(self, total):
        self.total = total

    def agg(self, _):
        return self

    def first(self):
        return [self.total]


@pytest.mark.parametrize("seed", range(60))
def test_cuts_are_those_of_all_groups(spark, monkeypatch, seed):
    draw = random.Random(seed)
    sizes = [draw.choice([8, 9, 50, 900, draw.randint(8, 4000)]) for _ in range(draw.choice([1, 3, 30, 700, 4000]))]
    if seed % 3 == 0:
        sizes[draw.randrange(len(sizes))] = sum(sizes) // 2 + 8  # a hot group
    shards = draw.choice([1, 2, 5, 24])
    monkeypatch.setattr(sharding, "_cells", cells_of(sizes))
    found = sharding.minimax_cuts(Total(sum(sizes)), shards, cells=draw.choice([64, 256]))
    assert found == best_cuts(sizes, shards)


def test_the_greatest_shard_is_as_small_as_any_partition_has_it():
    draw = random.Random(5)
    for _ in range(40):
        sizes = [draw.randint(1, 30) for _ in range(draw.randint(1, 12))]
        shards = draw.randint(1, 5)
        least = {}

        def smallest(at, left):
            if at == len(sizes):
                return 0
            if left == 0:
                return float("inf")
            if (at, left) not in least:
                least[at, left] = min(max(sum(sizes[at:to]), smallest(to, left - 1)) for to in range(at + 1, len(sizes) + 1))
            return least[at, left]

        bounds = [0, *best_cuts(sizes, shards), sum(sizes)]
        assert max(b - a for a, b in pairwise(bounds)) == smallest(0, shards)
        assert len(bounds) - 1 <= shards


def check_shards(docs, found, shards, spark):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("key")).collect()
    groups = Counter()
    for r in rows:
        groups[r["key"]] += len(r["text"].encode()) + 8
    ordered = sorted(groups)
    cuts, at, shard_of = best_cuts([groups[k] for k in ordered], shards) if ordered else [], 0, {}
    for key in ordered:
        shard_of[key] = sum(cut <= at for cut in cuts)
        at += groups[key]
    want = Counter((r["doc_id"], len(r["text"].encode()) + 8, zlib.crc32(r["text"].encode()), shard_of[r["key"]]) for r in rows)
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in found)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(held) == list(range(len(held))) for held in slots.values())


def test_shards_of_documents(small, odd, nothing, workspace, spark):
    for docs, shards in ((small, 24), (odd, 3), (nothing, 24)):
        check_shards(docs, sharding.shard_rows(docs, workspace, shards).collect(), shards, spark)


def test_written_shards_hold_every_row(odd, workspace, tmp_path, spark):
    path = str(tmp_path / "shards")
    sharding.write_shards(odd, path, workspace, shards=3)
    read = spark.read.parquet(path)
    assert Counter(map(repr, read.select(*odd.columns).collect())) == Counter(map(repr, odd.collect()))
    pairs = {(r["shard"], r["doc_id"]) for r in read.collect()}
    assert pairs == {(r["shard"], r["doc_id"]) for r in sharding.shard_rows(odd, workspace, 3).collect()}


# ---------------------------------------------------------------- hard negatives


def brute_force(rows, divisor, wanted):
    clean = [
        (i, label, tuple(int(np.floor(256 * x)) for x in v)) for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    anchors = {}
    for i, label, v in sorted(clean):
        if i % divisor == 0:
            anchors.setdefault(i, (label, v))
    found = []
    for i, (label, v) in anchors.items():
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w in clean if j != i and len(w) == len(v)
        )
        for down, positive, _ in [s for s in scored if s[2]][:wanted]:
            fits = [s for s in scored if not s[2] and 80 * -down <= 100 * -s[0] <= 100 * -down][:wanted]
            found += [(i, positive, rank + 1, j, -down, -s) for rank, (s, j, _) in enumerate(fits)]
    return Counter(found)


def vectors(seed, count, dim, spread):
    """Clusters about a few centres, half of each label, with one vector many times."""
    random = np.random.default_rng(seed)
    centres = random.standard_normal((8, dim))
    made = []
    for i in range(count):
        k = random.integers(8)
        v = centres[k] + spread * random.standard_normal(dim)
        if i % 9 == 0:
            v = centres[0]
        v = v / np.linalg.norm(v) * random.choice([0.3, 1, 1, 2])
        made.append((i, int(random.integers(3)), [float(x) for x in v]))
    return made


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("seed, dim, spread, block_values", [(1, 6, 0.1, 60), (2, 16, 0.4, 16 * 20), (3, 3, 2.0, 1 << 18), (4, 1, 0.1, 7)])
def test_negatives_against_brute_force(spark, workspace, seed, dim, spread, block_values):
    rows = vectors(seed, 400, dim, spread)
    table = spark.createDataFrame(rows, SCHEMA)
    found = negatives.hard_negatives(table, workspace, F.col("label"), anchor_divisor=20, block_values=block_values)
    assert Counter(map(tuple, found.collect())) == brute_force(rows, 20, 5)


def test_negatives_of_odd_rows(spark, workspace):
    nan, inf = float("nan"), float("inf")
    rows = vectors(7, 60, 4, 0.3)
    rows += [(None, 1, [1.0] * 4), (100, None, [1.0] * 4), (200, 1, None), (300, 1, [1.0, nan, 0.0, 0.0]), (400, 1, [1.0, inf, 0.0, 0.0]),
             (500, 1, [1.0, None, 0.0, 0.0]), (600, 1, [0.0] * 4), (601, 1, [0.0] * 4), (602, 0, [0.0] * 4), (700, 1, []), (701, 1, []),
             (800, 1, [0.5, 0.5]), (801, 1, [0.5, 0.5]), (802, 0, [0.5, 0.45]), (20, 2, [0.1, 0.2, 0.3, 0.4]), (40, 0, [0.1] * 4), (41, 0, [0.1] * 4),
             (41, 0, [0.1] * 4), (-20, 1, [-0.5, 0.1, 0.2, 0.3]), (900, 1, [40.0, -3.0, 7.0, 1.0]), (901, 1, [40.0, -3.5, 7.0, 1.0]), (902, 2, [39.0, -3.5, 7.0, 1.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", v string, score int")
    found = negatives.hard_negatives(table, workspace, F.col("label"), anchor_divisor=20, block_values=40)
    assert Counter(map(tuple, found.collect())) == brute_force(rows, 20, 5)
    assert negatives.hard_negatives(table.limit(0), workspace, F.col("label")).count() == 0


def test_windows_leave_rows_out_but_none_that_counts():
    random = np.random.default_rng(3)
    centre = random.standard_normal(8)
    v = centre + random.standard_normal((500, 8))
    v = np.floor(1000 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    units, norms = negatives._units(v)
    references = np.stack([centre / np.linalg.norm(centre), np.eye(8)[0]])
    angles = np.arccos(np.clip(units @ references.T, -1, 1))
    order = np.argsort(angles[:, 0])
    v, norms, angles = v[order], norms[order], angles[order]
    block = negatives.Block(0, np.arange(500), np.zeros(500, np.int64), v, norms, angles)
    scores = v @ v.T
    left_out = 0
    for percent in (99, 90, 60):
        least = np.percentile(scores, percent, axis=1).astype(np.int64).astype(float)
        most = least * 1.02
        start, end = block.windows(norms, angles, least, most)
        inside = (np.arange(500) >= start[:, None]) & (np.arange(500) < end[:, None])
        fits = (scores >= least[:, None]) & (scores <= most[:, None])
        assert not (fits & ~inside).any()
        left_out += (~inside).sum()
    assert left_out > 0


# ---------------------------------------------------------------- manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def steps(levels, place):
    for nodes in levels[:-1]:
        run = place - place % 16
        yield nodes[run:place], nodes[place + 1 : run + 16]
        place //= 16


def whole_manifest(rows):
    sources = defaultdict(list)
    for i, text, lang, source, n_chars in rows:
        own = leaf((i, source, lang, n_chars, text))
        changed = own
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None:
            changed = leaf((i, source, lang, n_chars, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
        sources["" if source is None else "+" + source].append((i is not None, i or 0, own, changed))
    names = sorted(sources, key=lambda s: s.encode())
    trees = {name: tree([r[2] for r in sorted(sources[name])]) for name in names}
    top = tree([trees[name][-1][0] for name in names])
    found = []
    for at, name in enumerate(names):
        for place, (known, i, own, changed) in enumerate(sorted(sources[name])):
            way = [*steps(trees[name], place), *steps(top, at)]
            node = changed
            for before, after in way:
                node = digest("".join(before) + node + "".join(after))
            proof = digest("".join("".join(b) + "".join(a) for b, a in way))
            root = top[-1][0]
            found.append((i if known else None, own, trees[name][-1][0], root, proof, node, node == root))
    return Counter(found)


FIVE = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_of_documents(small, workspace, levels):
    found = merkle.manifest(small, workspace, local_levels=levels)
    assert Counter(map(tuple, found.collect())) == whole_manifest(map(tuple, small.select(*FIVE).collect()))


@pytest.mark.parametrize("sizes", [[1, 16, 17, 256, 257], [4113, 1], [300] + [1] * 40, [33]])
def test_manifest_through_several_rounds(spark, workspace, sizes):
    rows = [(i, f"Text {i}", "en", f"s{k:03}", i) for k, size in enumerate(sizes) for i in range(k * 10_000, k * 10_000 + size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.manifest(docs, workspace, local_levels=1)
    assert Counter(map(tuple, found.collect())) == whole_manifest(rows)


def test_manifest_of_odd_rows(odd, nothing, workspace):
    rows = [r[:5] for r in odd_rows()]
    found = merkle.manifest(odd, workspace, local_levels=1).collect()
    assert Counter(map(tuple, found)) == whole_manifest(rows)
    assert merkle.manifest(nothing, workspace).count() == 0
