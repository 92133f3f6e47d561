"""Log-bilinear language model, trained in numpy by noise-contrastive estimation.

Tokens are words (A-Z in lower case) and one end token per text. A token's probability is that of
its class given the two classes before it, times that of the word within its class given the same:

* The TOP most frequent words are classes of their own; all others share at most SUFFIXES classes by their last
  two bytes. The class model (Mnih and Hinton, 2007) predicts a vector from the two context
  vectors by one matrix each, r = R[c1] A1 + R[c2] A2, and scores class w by r . Q[w] + b[w].
* Within a shared class, each of the next VECTORS most frequent words has a vector of its own, and one entry stands
  for all others; r scores them by r . U[w] + c[w]. Frequent endings are split over several classes and rare
  ones joined, so that classes hold about the same number of such words.
* The words of that one entry have (c + 1) / (N + V + 1) each, over its N tokens and V words, c being
  the word's count: the missing 1 is for words never seen.

Because the class score is bilinear, S1 = R A1 Q' and S2 = R A2 Q' are tables over pairs of classes, and
one matrix product over all contexts gives every class normaliser exactly; within classes, tokens are
gathered by class and normalised by one matrix product each. Probabilities sum to one.

Texts are split into words once: their hashes are stored. Counts cover every training text and meet by
a shuffle of one row per word and task. Training runs inside the tasks: in each of ROUNDS rounds every
training text gives each ROUNDS-th of its positions, another set each time, so every position of every
training text is a target once. Each task makes one pass of minibatches from common parameters, and
each row of the parameters is averaged by how often the tasks have used it (Mnih and Teh, 2012, for the
estimation; iterative parameter mixing for the averaging). A step changes only the rows of its batch, and a
task hands on only the rows it has changed. So work and what is gathered grow with the corpus.

Head words, at most HEAD by a threshold on their counts taken from a bounded histogram, are broadcast
(6 MB) and looked up in the tasks. All other tokens are handed on by text and word and meet their counts in a
join, which holds no hot key: head words are not in it.

Defined results: a null, empty or blank text is its end token; a null id counts as a training text;
repeated rows are scored each, and counted each in training; without training texts all counts are
0 and classes are uniform; ties in count go to the smaller hash; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.llm.quality import bucket
from glasspool.llm.text import documents, mix, remainder, texts_of, words_and_ends
from glasspool.operators.joins import reshuffled
from glasspool.workspace import Workspace

TOP = 768
SUFFIXES = 256
CLASSES = TOP + SUFFIXES
START = CLASSES  # the context before a text
VECTORS = 1 << 15
HEAD = 1 << 18
WIDTH = 32
ROUNDS = 2
BATCH = 2048
NOISE = 32
INNER_NOISE = 1  # for each word of a shared class
RATE = 0.3
FLUSH_WORDS = 500_000
BLOCK_ROWS = 64  # parameter rows that are averaged together
PART_TASKS = 64  # tasks whose changes are added up first
ENDING = np.uint64(0xFFFF)
END = mix(np.array([0x656E64], dtype=np.uint64)) & ~ENDING  # no word ends with two zero bytes

HASHED = "doc_id long, held_out boolean, row long, hashes binary"
CODED = (
    "doc_id long, held_out boolean, row long, codes binary, n_tokens long, n_head long, head_log double, rest_log double, "
    "tail array<struct<word: long, n: int>>"
)


def tokens(text: bytes) -> np.ndarray:
    """The 64-bit name of each token of a text, the end token last: 48 bits of a hash, then its last two bytes."""
    hashes, ends = words_and_ends(text.lower())
    return np.concatenate([(hashes & ~ENDING) | ends, END])


def endings_of(words: np.ndarray) -> np.ndarray:
    return (words & ENDING).astype(np.int64)


def hashed(docs: DataFrame) -> DataFrame:
    """HASHED of (doc_id, held_out, row, text): eight bytes for each token."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([tokens(text).astype("<u8").tobytes() for text in texts_of(batch)], pa.binary())
            columns = [*(batch.column(c) for c in ("doc_id", "held_out", "row")), found]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "row", "hashes"])

    return docs.select("doc_id", "held_out", "row", "text").mapInArrow(split, HASHED)


def _tokens_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for one in texts_of(batch, "hashes"):
        yield np.frombuffer(one, "<u8")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of a result of `hashed`; each task counts before it hands on."""

    def handed(words: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(words), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = [], 0
        for batch in batches:
            for hashes in _tokens_of(batch):
                words.append(hashes)
                held += hashes.size
                if held > 4 * FLUSH_WORDS:
                    yield handed(words)
                    words, held = [], 0
        if words:
            yield handed(words)

    return texts.select("hashes").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Table:
    """Place of each of a set of 64-bit hashes: tables probed by other bits of the hash until all are placed."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []
        left = np.arange(keys.size)
        while left.size:
            bits = max(int(2 * left.size).bit_length(), 4)
            salt, shift = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.levels)), np.uint64(64 - bits)
            slots = (keys[left] * salt) >> shift
            where = np.full(1 << bits, -1, dtype=np.int32)
            where[slots[::-1]] = left[::-1]  # of several the first stays
            placed = where[slots] == left
            held = np.zeros(1 << bits, dtype=np.uint64)
            held[slots[placed]] = keys[left[placed]]
            self.levels.append((salt, shift, held, where))
            left = left[~placed]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those that are not in the set."""
        found, open_ = np.full(hashes.size, -1, dtype=np.int32), None
        for salt, shift, held, where in self.levels:
            asked = hashes if open_ is None else hashes[open_]
            slots = (asked * salt) >> shift
            hit = (held[slots] == asked) & (where[slots] >= 0)
            if open_ is None:
                found[hit], open_ = where[slots[hit]], np.flatnonzero(~hit)
            else:
                found[open_[hit]], open_ = where[slots[hit]], open_[~hit]
            if not open_.size:
                break
        return found


@dataclass
class Vocabulary:
    """Head words with their counts and codes, the classes of endings, and totals.

    A code below TOP is that of a top word and its class; others are TOP and the number of an entry. Entries
    are sorted by class, and the last entry of each class stands for all words without a vector.
    """

    words: np.ndarray
    counts: np.ndarray
    codes: np.ndarray  # -1 for words without a vector
    first: np.ndarray  # first shared class of each ending
    parts: np.ndarray  # number of classes it is split over
    starts: np.ndarray  # first entry of each shared class, and the end of all
    tokens: int
    distinct: int
    threshold: int
    prior: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # tokens of each class
    entry_counts: np.ndarray = field(default_factory=lambda: np.zeros(SUFFIXES))  # tokens of each entry
    rest: np.ndarray = field(default_factory=lambda: np.zeros(SUFFIXES))  # log10 (N + V + 1) of the last entries

    def __post_init__(self):
        self.table = Table(self.words)
        self.class_of = np.repeat(np.arange(SUFFIXES), np.diff(self.starts))

    @classmethod
    def of(cls, counts: DataFrame, head: int = HEAD, top: int = TOP, vectors: int = VECTORS) -> Vocabulary:
        tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        # at most 32 buckets for each power of two
        steps = counts.groupBy(bucket(F.col("n")).alias("least")).count().orderBy(F.desc("least")).collect()
        threshold, held = (steps[0]["least"] * 2 if steps else 1), 0
        for step in steps:
            held += step["count"]
            if held > head:
                break
            threshold = step["least"]
        frame = counts.filter(F.col("n") >= threshold).select("word", "n").toArrow().to_pandas()
        words = frame["word"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(words)
        words, numbers = words[order], frame["n"].to_numpy(dtype=np.int64)[order]
        best = np.lexsort((words, -numbers))
        own, vector = best[:top], best[top : top + vectors]
        first, parts = _classes_of_endings(endings_of(words[vector]))
        shared = _shared_class(first, parts, words[vector])
        vector = vector[np.argsort(shared, kind="stable")]
        sizes = np.bincount(shared, minlength=SUFFIXES) + 1
        starts = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.full(words.size, -1, dtype=np.int32)
        codes[own] = np.arange(own.size)
        # an entry's number is its place among the vectors plus the last entries of the classes before
        codes[vector] = TOP + np.arange(vector.size) + np.sort(shared)
        made = cls(words, numbers, codes, first, parts, starts, tokens, distinct, threshold)
        made._count(counts, own, vector)
        return made

    def _count(self, counts: DataFrame, own: np.ndarray, vector: np.ndarray) -> None:
        known = counts.sparkSession.sparkContext.broadcast(self)

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, v = np.zeros(SUFFIXES, dtype=np.int64), np.zeros(SUFFIXES, dtype=np.int64)
            for batch in batches:
                words = batch.column("word").to_numpy().view(np.uint64)
                codes = known.value.coded(words)[0]
                last, shared = known.value.without_vector(codes)
                n += np.bincount(shared[last], batch.column("n").to_numpy()[last], SUFFIXES).astype(np.int64)
                v += np.bincount(shared[last], minlength=SUFFIXES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SUFFIXES)), pa.array(n), pa.array(v)], names=["shared", "n", "v"])

        sums = counts.mapInArrow(rest, "shared long, n long, v long").groupBy("shared").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        self.entry_counts = np.zeros(self.starts[-1])
        self.entry_counts[self.codes[vector] - TOP] = self.counts[vector]
        inside = np.zeros(SUFFIXES)
        for row in sums.collect():
            self.entry_counts[self.starts[row["shared"] + 1] - 1] = row["n"]
            inside[row["shared"]] = row["n"] + row["v"]
        self.rest = np.log10(inside + 1)
        self.prior = np.zeros(CLASSES)
        self.prior[: own.size] = self.counts[own]
        self.prior[TOP:] = np.add.reduceat(self.entry_counts, self.starts[:-1])

    def coded(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, count) of each token; the count is 0 for words outside the head."""
        at = self.table.find(hashes)
        known = at >= 0
        codes = np.where(known, self.codes[at] if self.codes.size else -1, -1)
        plain = codes < 0
        shared = _shared_class(self.first, self.parts, hashes[plain])
        codes[plain] = TOP + self.starts[shared + 1] - 1
        return codes, np.where(known, self.counts[at] if self.counts.size else 0, 0)

    def without_vector(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a code is that of a last entry, and the shared class (0 for top words)."""
        shared = np.where(codes >= TOP, self.class_of[np.maximum(codes - TOP, 0)], 0)
        return (codes >= TOP) & (codes - TOP == self.starts[shared + 1] - 1), shared

    def classes(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= TOP, TOP + self.class_of[np.maximum(codes - TOP, 0)], codes)

    def shares(self) -> np.ndarray:
        """Smoothed share of each class."""
        return (self.prior + 1) / (self.prior + 1).sum()

    def inner_shares(self) -> np.ndarray:
        """Smoothed share of each entry within its class."""
        counts = self.entry_counts + 1
        return counts / np.repeat(np.add.reduceat(counts, self.starts[:-1]), np.diff(self.starts))


def _classes_of_endings(endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first class, number of classes) of each of the 65,536 endings, from those of the words with vectors."""
    present, sizes = np.unique(endings, return_counts=True)
    most = max(1, -(-int(endings.size) // SUFFIXES))
    while True:
        first, parts, at, held = {}, {}, 0, 0
        for ending, size in zip(present.tolist(), sizes.tolist()):
            if size > most:  # classes of its own
                at, held = at + (held > 0), 0
                first[ending], parts[ending] = at, -(-size // most)
                at += parts[ending]
                continue
            if held + size > most:
                at, held = at + 1, 0
            first[ending], parts[ending] = at, 1
            held += size
        if at + (held > 0) <= SUFFIXES:
            break
        most += max(1, most // 8)
    all_first = (np.arange(1 << 16) * 40503) % SUFFIXES  # endings no such word has
    all_parts = np.ones(1 << 16, dtype=np.int64)
    for ending in first:
        all_first[ending], all_parts[ending] = first[ending], parts[ending]
    return all_first, all_parts


def _shared_class(first: np.ndarray, parts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    endings = endings_of(hashes)
    split = (hashes >> np.uint64(40)).astype(np.int64) % parts[endings]
    return first[endings] + split


def encoded(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """CODED of HASHED: two bytes for each token, and what counts alone give."""
    known = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        for batch in batches:
            held = list(_tokens_of(batch))
            if not held:
                continue
            sizes = np.array([h.size for h in held])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            hashes = np.concatenate(held)
            codes, counts = v.coded(hashes)
            hit, log = counts > 0, np.log10(counts + 1)
            last, shared = v.without_vector(codes)
            of_text = lambda values: np.add.reduceat(values.astype(np.float64), starts[:-1])
            codes = codes.astype("<u2")  # TOP, VECTORS and SUFFIXES are fewer than 65,536
            lengths, words, times = [0], [], []
            for start, end in zip(starts[:-1], starts[1:]):
                tail, often = np.unique(hashes[start:end][~hit[start:end]], return_counts=True)
                lengths.append(lengths[-1] + tail.size)
                words.append(tail)
                times.append(often)
            tails = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(words).view(np.int64), pa.int64()), pa.array(np.concatenate(times).astype(np.int32), pa.int32())],
                names=["word", "n"],
            )
            columns = [*(batch.column(c) for c in ("doc_id", "held_out", "row")),
                       pa.array([codes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
                       pa.array(sizes, pa.int64()), pa.array(of_text(hit).astype(np.int64)), pa.array(of_text(log)),
                       pa.array(of_text(np.where(last, log - v.rest[shared], 0))), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), tails)]
            names = [part.split()[0] for part in CODED.split(", ")[:8]] + ["tail"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(encode, CODED)


def shapes(entries: int) -> dict[str, tuple[int, ...]]:
    return {
        "R": (CLASSES + 1, WIDTH), "A1": (WIDTH, WIDTH), "A2": (WIDTH, WIDTH), "Q": (CLASSES, WIDTH), "b": (CLASSES,),
        "U": (entries, WIDTH), "c": (entries,),
    }


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    random = np.random.default_rng(2007)
    made = {name: (random.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in shapes(int(vocabulary.starts[-1])).items()}
    made["A1"] += np.eye(WIDTH, dtype=np.float32)
    made["A2"] += np.eye(WIDTH, dtype=np.float32) / 2
    made["b"] = np.log(vocabulary.shares()).astype(np.float32)
    made["c"] = np.log(vocabulary.inner_shares()).astype(np.float32)
    return made


class Trainer:
    """Noise-contrastive estimation by minibatches with per-parameter step sizes."""

    def __init__(self, parameters: dict[str, np.ndarray], shares: np.ndarray, inner: np.ndarray, starts: np.ndarray, seed: int):
        self.p = {name: value.copy() for name, value in parameters.items()}
        self.squares = {name: np.full_like(value, 1e-2) for name, value in self.p.items()}
        self.used = {name: np.zeros(len(value), dtype=np.float32) for name, value in self.p.items()}
        self.log_noise = np.log(NOISE * shares).astype(np.float32)
        self.cumulative = np.cumsum(shares)
        self.inner_log_noise = np.log(INNER_NOISE * inner).astype(np.float32)
        # shares within a class lie between its number and the next
        self.inner_cumulative = np.cumsum(inner)
        self.starts = starts
        self.random = np.random.default_rng(seed)
        self.trained = 0

    def step(self, near: np.ndarray, far: np.ndarray, target: np.ndarray, entry: np.ndarray) -> None:
        """`entry` is the target's entry within its class, -1 for classes of one word."""
        p = self.p
        noise = np.minimum(np.searchsorted(self.cumulative, self.random.random(NOISE)), CLASSES - 1)
        x1, x2 = p["R"][near], p["R"][far]
        r = x1 @ p["A1"] + x2 @ p["A2"]
        q, qn = p["Q"][target], p["Q"][noise]
        true = _sigmoid(self.log_noise[target] - p["b"][target] - np.einsum("ij,ij->i", r, q))
        false = r @ qn.T
        false += p["b"][noise] - self.log_noise[noise]
        false = np.negative(_sigmoid(false), out=false)
        dr = true[:, None] * q + false @ qn
        self._inner(r, dr, target, entry)
        seen, drawn = np.concatenate([near, far]), np.concatenate([target, noise])
        rows, sums = _summed(seen, np.concatenate([dr @ p["A1"].T, dr @ p["A2"].T]))
        self._update("R", rows, sums, target.size)
        rows, sums = _summed(drawn, np.concatenate([true[:, None] * r, false.T @ r]))
        self._update("Q", rows, sums, target.size)
        biases = np.bincount(drawn, np.concatenate([true, false.sum(axis=0)]), CLASSES).astype(np.float32)
        self._update("b", slice(None), biases, target.size)
        self._update("A1", slice(None), x1.T @ dr, target.size)
        self._update("A2", slice(None), x2.T @ dr, target.size)
        self.trained += target.size

    def _inner(self, r: np.ndarray, dr: np.ndarray, target: np.ndarray, entry: np.ndarray) -> None:
        """Words against noise of their own class; adds to the gradient of r."""
        some = np.flatnonzero(entry >= 0)
        if not some.size:
            return
        p, ri, mine = self.p, r[some], entry[some]
        shared = target[some] - TOP
        low, high = self.starts[shared], self.starts[shared + 1]
        drawn = np.searchsorted(self.inner_cumulative, shared[:, None] + self.random.random((some.size, INNER_NOISE)))
        drawn = np.clip(drawn, low[:, None], high[:, None] - 1)
        rows = np.concatenate([mine[:, None], drawn], axis=1)
        u = p["U"][rows]
        logits = np.einsum("nkw,nw->nk", u, ri) + p["c"][rows] - self.inner_log_noise[rows]
        logits[:, 0] *= -1
        pull = _sigmoid(logits)
        pull[:, 1:] *= -1
        dr[some] += np.einsum("nk,nkw->nw", pull, u)
        # sorted by row before the products are made, once for vectors and biases
        order, starts, found = _sorted_rows(rows.ravel())
        weights = pull.ravel()[order][:, None]
        values = ri[order // rows.shape[1]]
        values *= weights
        self._update("U", found, np.add.reduceat(values, starts, axis=0), target.size)
        self._update("c", found, np.add.reduceat(weights, starts, axis=0)[:, 0], target.size)

    def _update(self, name: str, rows: np.ndarray | slice, grad: np.ndarray, size: int) -> None:
        """A step of the given rows; others have no gradient."""
        grad *= np.float32(1 / size)
        squares = self.squares[name][rows]
        squares = squares + grad * grad
        self.squares[name][rows] = squares
        grad *= np.float32(RATE)
        grad /= np.sqrt(squares)
        self.p[name][rows] += grad
        self.used[name][rows] += 1


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)), in place."""
    np.negative(z, out=z)
    np.minimum(z, 30, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the rows, where each distinct one starts in it, and the distinct rows."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # radix sort
    ordered = rows[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    return order, starts, ordered[starts]


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the sum of the values of each."""
    order, starts, found = _sorted_rows(rows)
    return found, np.add.reduceat(np.take(values, order, axis=0), starts, axis=0)


def _contexts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.concatenate([[START], classes[:-1]])
    return near, np.concatenate([[START], near[:-1]])


def _flat(parameters: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters as rows of WIDTH + 1, one below the other: an entry's bias stands beside its vector,
    class biases fill rows of their own."""
    wide = [np.pad(parameters[name], ((0, 0), (0, 1))) for name in ("R", "A1", "A2", "Q")]
    return np.concatenate([*wide, _folded(parameters["b"]), np.column_stack([parameters["U"], parameters["c"]])])


def _folded(numbers: np.ndarray) -> np.ndarray:
    return np.pad(numbers, (0, -numbers.size % (WIDTH + 1))).reshape(-1, WIDTH + 1)


def _unflat(flat: np.ndarray, entries: int) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for name, shape in shapes(entries).items():
        rows = shape[0] if len(shape) == 2 else -(-shape[0] // (WIDTH + 1))
        part = flat[at : at + rows]
        if name == "b":
            found[name] = part.ravel()[: shape[0]]
        elif name == "U":
            found["U"], found["c"] = np.ascontiguousarray(part[:, :WIDTH]), part[:, WIDTH].copy()
            break
        else:
            found[name] = np.ascontiguousarray(part[:, :WIDTH])
        at += rows
    return found


def _used_rows(used: dict[str, np.ndarray]) -> np.ndarray:
    """How often each row of `_flat` was changed. Class biases are all changed in each step."""
    parts = [used[name] for name in ("R", "A1", "A2", "Q")]
    return np.concatenate([*parts, _folded(used["b"]).max(axis=1), used["U"]])


#: of a task: how often each row of a block was changed and by how much, as 32- and 16-bit numbers;
#: of several: the sums of the weights and of the weighted changes, as 64- and 32-bit numbers
_SUMS = "block long, part long, weights binary, sums binary"


def _sum_of(table: pa.Table, weights: list[np.ndarray], sums: list[np.ndarray]) -> pa.Table:
    return pa.table({
        "block": pa.array([table.column("block")[0].as_py()], pa.int64()), "part": pa.array([0], pa.int64()),
        "weights": pa.array([np.sum(weights, axis=0, dtype=np.float64).tobytes()], pa.binary()),
        "sums": pa.array([np.sum(sums, axis=0, dtype=np.float64).astype(np.float32).tobytes()], pa.binary()),
    })


def _weighted(key: tuple, table: pa.Table) -> pa.Table:
    """The sums over the tasks of one part."""
    weights = [np.frombuffer(w.as_py(), np.float32) for w in table.column("weights")]
    moved = [np.frombuffer(s.as_py(), np.float16).astype(np.float32) for s in table.column("sums")]
    return _sum_of(table, weights, [m.reshape(w.size, -1) * w[:, None] for m, w in zip(moved, weights)])


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """The sums over the parts."""
    weights = [np.frombuffer(w.as_py(), np.float64) for w in table.column("weights")]
    return _sum_of(table, weights, [np.frombuffer(s.as_py(), np.float32) for s in table.column("sums")])


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters from `encoded` texts, each row averaged over the tasks by how often they have changed it."""
    entries, parameters = int(vocabulary.starts[-1]), initial(vocabulary)
    context = texts.sparkSession.sparkContext
    known = context.broadcast((vocabulary.shares(), vocabulary.inner_shares(), vocabulary.starts, vocabulary.class_of))
    for turn in range(rounds):
        start = context.broadcast(parameters)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shares, inner, starts, class_of = known.value
            trainer, waiting, held, number = Trainer(start.value, shares, inner, starts, turn), [], 0, 0
            for batch in batches:
                number = number or batch.column("row")[0].as_py() >> 33  # the partition's number spreads the sums
                for text in texts_of(batch, "codes"):
                    codes = np.frombuffer(text, dtype="<u2").astype(np.int64)
                    entry = np.where(codes >= TOP, codes - TOP, -1)
                    classes = np.where(entry >= 0, TOP + class_of[np.maximum(entry, 0)], codes)
                    near, far = _contexts(classes)
                    # which positions depends on the text alone, so a repeated task trains alike
                    chosen = slice((classes.size + turn) % rounds, None, rounds)
                    waiting.append(np.stack([near[chosen], far[chosen], classes[chosen], entry[chosen]]))
                    held += waiting[-1].shape[1]
                    if held >= 32 * BATCH:
                        _run(trainer, waiting)
                        waiting, held = [], 0
            if held:
                _run(trainer, waiting)
            if trainer.trained:
                yield _handed(trainer, start.value, number // PART_TASKS)

        handed = texts.select("row", "codes").mapInArrow(learn, _SUMS)
        # some tasks' sums first, then all: what meets in one task stays small however many tasks there are
        some = handed.groupBy("block", "part").applyInArrow(_weighted, _SUMS)
        frame = some.groupBy("block").applyInArrow(_added, _SUMS).toArrow()
        if not frame.num_rows:
            break
        flat = _flat(parameters).astype(np.float32)
        for block, weights, sums in zip(*(frame.column(c).to_pylist() for c in ("block", "weights", "sums"))):
            weights = np.frombuffer(weights, np.float64)[:, None]
            moved = np.frombuffer(sums, np.float32).reshape(-1, WIDTH + 1) / np.maximum(weights, 1e-9)
            flat[block * BLOCK_ROWS : block * BLOCK_ROWS + len(moved)] += np.where(weights > 0, moved, 0).astype(np.float32)
        parameters = _unflat(flat, entries)
    return parameters


def _handed(trainer: Trainer, start: dict[str, np.ndarray], part: int) -> pa.RecordBatch:
    """Changes of the blocks of rows that the task has changed."""
    weights = _used_rows(trainer.used).astype(np.float32)
    moved = np.clip(_flat(trainer.p) - _flat(start), -60_000, 60_000).astype(np.float16)
    blocks = [k for k in range(0, len(weights), BLOCK_ROWS) if weights[k : k + BLOCK_ROWS].any()]
    columns = [pa.array([k // BLOCK_ROWS for k in blocks], pa.int64()), pa.array([part] * len(blocks), pa.int64()),
               pa.array([weights[k : k + BLOCK_ROWS].tobytes() for k in blocks], pa.binary()),
               pa.array([moved[k : k + BLOCK_ROWS].tobytes() for k in blocks], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "part", "weights", "sums"])


def _run(trainer: Trainer, waiting: list[np.ndarray]) -> None:
    near, far, target, entry = np.concatenate(waiting, axis=1)
    order = trainer.random.permutation(target.size)
    for at in range(0, order.size, BATCH):
        part = order[at : at + BATCH]
        trainer.step(near[part], far[part], target[part], entry[part])


@dataclass
class Tables:
    """log10 P(class | two before) = first[near, class] + second[far, class] - norm[near, far]; entries within
    a class are scored by the predicted vector one[near] + two[far]."""

    first: np.ndarray
    second: np.ndarray
    norm: np.ndarray
    one: np.ndarray
    two: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, p: dict[str, np.ndarray], starts: np.ndarray) -> Tables:
        one, two = p["R"] @ p["A1"], p["R"] @ p["A2"]
        first, second = one @ p["Q"].T + p["b"], two @ p["Q"].T
        norm = np.empty((CLASSES + 1, CLASSES + 1), dtype=np.float64)
        # exp(first + second) is a product, so sums over classes are a matrix product
        top1, top2 = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        e1, e2 = np.exp((first - top1).astype(np.float64)), np.exp((second - top2).astype(np.float64))
        np.log(e1 @ e2.T + 1e-300, out=norm)
        norm += top1 + top2.T
        ten = math.log(10)
        small = lambda x: (x / ten).astype(np.float32)
        return cls(small(first), small(second), small(norm), one, two, p["U"], p["c"], starts)

    def class_logs(self, near: np.ndarray, far: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return self.first[near, classes].astype(np.float64) + self.second[far, classes] - self.norm[near, far]

    def entry_logs(self, near: np.ndarray, far: np.ndarray, shared: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """log10 P(entry | class, two before): one matrix product for each class."""
        found = np.empty(entry.size)
        order = np.argsort(shared.astype(np.uint16), kind="stable")
        bounds = np.searchsorted(shared[order], np.arange(SUFFIXES + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            at, low, high = order[bounds[k] : bounds[k + 1]], self.starts[k], self.starts[k + 1]
            z = (self.one[near[at]] + self.two[far[at]]) @ self.inner[low:high].T
            z += self.bias[low:high]
            z -= z.max(axis=1, keepdims=True)
            own = z[np.arange(at.size), entry[at] - low].astype(np.float64)
            found[at] = own - np.log(np.exp(z, out=z).sum(axis=1, dtype=np.float64))
        return found / math.log(10)


def model_scores(texts: DataFrame, vocabulary: Vocabulary, tables: Tables) -> DataFrame:
    """(row, model_log) of `encoded` texts: all of a score but the shares of words without a vector."""
    context = texts.sparkSession.sparkContext
    known, model = context.broadcast(vocabulary.class_of), context.broadcast(tables)

    def scored(held: list[np.ndarray], numbers: list[int]) -> pa.RecordBatch:
        sizes = np.array([codes.size for codes in held])
        starts = np.cumsum(sizes) - sizes
        entry = np.concatenate(held).astype(np.int64) - TOP
        shared = known.value[np.maximum(entry, 0)]
        classes = np.where(entry >= 0, TOP + shared, entry + TOP)
        near, far = _contexts(classes)
        far[starts], near[starts] = START, START
        second = starts[sizes > 1] + 1
        far[second] = START
        logs = model.value.class_logs(near, far, classes)
        some = np.flatnonzero(entry >= 0)
        logs[some] += model.value.entry_logs(near[some], far[some], shared[some], entry[some])
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(np.add.reduceat(logs, starts))], names=["row", "model_log"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, size = [], [], 0
        for batch in batches:
            for number, text in zip(batch.column("row").to_pylist(), texts_of(batch, "codes")):
                held.append(np.frombuffer(text, "<u2"))
                numbers.append(number)
                size += held[-1].size
                if size > FLUSH_WORDS // 2:
                    yield scored(held, numbers)
                    held, numbers, size = [], [], 0
        if held:
            yield scored(held, numbers)

    return texts.select("row", "codes").mapInArrow(score, "row long, model_log double")


def score(docs: DataFrame, workspace: Workspace, divisor: int = 7, held_remainder: int = 2,
          id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    narrow = documents(docs, id_column=id_column, text_column=text_column).withColumns(
        {
            "held_out": remainder(divisor) == held_remainder,
            "doc_id": F.col("doc_id").cast("long"),
            "row": F.monotonically_increasing_id(),
        }
    )
    texts = workspace.store(hashed(narrow))
    counts = workspace.store(word_counts(texts.filter(~F.col("held_out"))))
    vocabulary = Vocabulary.of(counts)
    codes = workspace.store(encoded(texts, vocabulary))
    tables = Tables.of(train(codes.filter(~F.col("held_out")), vocabulary), vocabulary.starts)
    scored = model_scores(codes, vocabulary, tables)
    rare = counts.filter(F.col("n") < vocabulary.threshold).select("word", F.col("n").alias("c"))
    found = (
        codes.select("row", F.inline("tail"))
        .join(reshuffled(rare, "word"), "word")
        .groupBy(F.col("row").alias("at"))
        .agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"))
    )
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    share = math.log10(vocabulary.tokens + vocabulary.distinct + 1)
    met = codes.drop("codes", "tail").join(scored, "row").join(found, F.col("row") == F.col("at"), "left")
    return met.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * share).alias("base_score"),
        (F.col("model_log") + F.col("rest_log") + rare_log).alias("score"),
    )
