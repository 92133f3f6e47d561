"""Sum-of-squares packing of tokenised documents into sequences of at most `capacity` tokens.

Sum of squares (Csirik, Johnson, Kenyon, Orlin, Shor and Weber, 2006): an item goes where the sum,
over residual gaps, of the squared number of open bins with that gap becomes smallest; of equal
places the tightest gap wins. Items come longest first.

The rule needs the lengths alone. Pieces are dealt to shards by a hash of (document, piece); the
number of shards grows with the pieces, so no task holds more than about SHARD_PIECES of them. What
a shard leaves loosely filled is taken apart, dealt to fewer shards and packed again. This stops when
nothing is loose, when more than half of a round's pieces stay loose, or after ROUNDS rounds; no piece is
lost, but with many shards each may keep a few loose sequences. Each round is written to the shared folder.

Defined results: a null or empty text is the end token alone; ties go to the smaller document id
and piece; documents with equal ids and texts are packed each; a document longer than the capacity
is cut into full pieces and a rest; no documents give no pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.llm.text import PieceCache, documents, texts_of
from glasspool.workspace import Workspace

CAPACITY = 4096
SHARD_PIECES = 50_000
SPREAD_SHARDS = 16
LEAST_SHARD_PIECES = 1000
LOOSE_GAP = 16
ROUNDS = 3
END_ID = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
PLACES = "doc_id long, piece int, row long, length long, bin long, gap int, offset long"

#: texts are encoded together up to this many bytes, so that a word met in many is looked up once
BATCH_BYTES = 1 << 20

#: a word in a line: letters that lower-casing and composition leave one letter each, then marks of another
#: class; or any other word
_words = re.compile(r"^(?:([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,;:!?|%*&$#]{0,4})|(.+))$", re.MULTILINE)
_encoders: dict = {}


class WordEncoder:
    """Token ids of words, for lower-casing tokenizers that never join tokens across ASCII white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker for each core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for plain words in lower case: the same merges, without normaliser and word pattern
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends_word[number] = token.endswith("</w>")
        self.tails: dict[str, bytes] = {}
        self.cache = PieceCache()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The encoder of this Python worker."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        # lower case makes fewer words to learn, but could turn other text into a special token
        words = [(text if b"<|" in text else text.lower()).split() for text in texts]
        ids_of = self.cache.table(set().union(*words), self._learn).__getitem__
        return [b"".join(map(ids_of, some)) for some in words]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        if not words:
            return {}
        found = _words.findall(b"\n".join(words).decode("utf-8", "replace"))
        cores = self._encode_cores({core for core, _, _ in found if core})
        others = dict.fromkeys(other for _, _, other in found if other)
        others = dict(zip(others, self._encode(list(others))))
        for tail in {tail for _, tail, _ in found}.difference(self.tails):  # at most four of a dozen characters
            self.tails[tail] = self._encode([tail])[0]
        tails = self.tails
        return {
            word: cores[core] + tails[tail] if core else others[other]
            for word, (core, tail, other) in zip(words, found)
        }

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(some.ids, dtype="<u4").tobytes() for some in found]

    def _encode_cores(self, cores: set[str]) -> dict[str, bytes]:
        """Each core is one word to the tokenizer, so its ids end with the next word-ending id."""
        if not cores:
            return {}
        found = self.plain.encode_batch_fast([" ".join(cores).lower()], add_special_tokens=False)
        ids = np.array(found[0].ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        data, starts = ids.tobytes(), [0, *ends.tolist()]
        return {core: data[starts[k] : starts[k + 1]] for k, core in enumerate(cores)}


def _together(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about BATCH_BYTES; a longer text ends its run."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= BATCH_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """PIECES of every document: its ids and the end id, cut every `capacity` ids. `row` numbers the
    rows of one run and tells repeated documents apart."""
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            rows = batch.column("row").to_pylist()
            found = (ids for texts in _together(texts_of(batch)) for ids in encoder.ids(texts))
            for doc_id, row, ids in zip(batch.column("doc_id").to_pylist(), rows, found):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), row))
            columns = zip(*out) if out else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = [field.split()[0] for field in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    numbered = documents(docs, id_column=id_column, text_column=text_column).withColumn(
        "row", F.monotonically_increasing_id()
    )
    return numbered.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, in the given order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    chosen = np.empty(lengths.size, dtype=np.int64)
    bins = 0
    for k, length in enumerate(lengths.tolist()):
        # moving a bin from gap g to g - length changes the sum by 2 * (N[g - length] - N[g] + 1),
        # by 1 - 2 * N[g] if that fills it; a new bin changes it by 2 * N[capacity - length] + 1
        gaps = np.flatnonzero(count[length:])
        best, place = 2 * int(count[capacity - length]) + 1 if length < capacity else 0, -1
        if gaps.size:
            cost = 2 * (count[gaps] - count[gaps + length] + 1)
            if gaps[0] == 0:
                cost[0] = 1 - 2 * count[length]
            at = int(cost.argmin())
            if cost[at] <= best:
                place = int(gaps[at]) + length
        if place < 0:
            number, bins, left = bins, bins + 1, capacity - length
        else:
            number, left = open_bins[place].pop(), place - length
            count[place] -= 1
        if left:
            open_bins[left].append(number)
            count[left] += 1
        chosen[k] = number
    return chosen


def _pack_shard(capacity: int):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True])
        lengths = items["length"].to_numpy()
        chosen = sum_of_squares(lengths, capacity)
        order = np.argsort(chosen, kind="stable")
        sizes = np.bincount(chosen, weights=lengths).astype(np.int64)
        before = np.cumsum(lengths[order]) - lengths[order]
        offsets = np.empty_like(before)
        offsets[order] = before - (np.cumsum(sizes) - sizes)[chosen[order]]
        return items.drop(columns="shard").assign(
            bin=chosen + (np.int64(items["shard"].iloc[0]) << 40), gap=capacity - sizes[chosen], offset=offsets
        )

    return pack


def places(items: DataFrame, workspace: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, row, sequence_id, offset) of (doc_id, piece, row, length)."""
    narrow = items.select("doc_id", "piece", "row", "length")
    done, rest, left = [], narrow, narrow.count()
    for turn in range(ROUNDS):
        shards = max(min(SPREAD_SHARDS, left // LEAST_SHARD_PIECES), -(-left // SHARD_PIECES), 1)
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row", F.lit(turn)), F.lit(shards)))
        packed = workspace.store(dealt.groupBy("shard").applyInPandas(_pack_shard(capacity), PLACES))
        packed = packed.withColumn("bin", F.col("bin") + (turn << 60))
        loose = F.col("gap") >= LOOSE_GAP
        rest, before = packed.filter(loose), left
        left = rest.count() if turn < ROUNDS - 1 else 0
        # packing again pays only while far fewer pieces are left than there were
        if not left or left * 2 > before:
            done.append(packed)
            break
        done.append(packed.filter(~loose))
        rest = rest.select("doc_id", "piece", "row", "length")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select("doc_id", "piece", "row", F.col("bin").alias("sequence_id"), "offset")


def pack(docs: DataFrame, workspace: Workspace, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    cut = workspace.store(pieces(docs, tokenizer, capacity, end_id, id_column, text_column))
    placed = places(cut, workspace, capacity)
    return (
        cut.join(placed.select(F.col("row").alias("r"), F.col("piece").alias("p"), "sequence_id", "offset"),
              (F.col("row") == F.col("r")) & (F.col("piece") == F.col("p")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    )
