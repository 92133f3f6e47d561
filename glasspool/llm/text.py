"""Words of UTF-8 texts as 64-bit hashes, and what the operators share about frames of documents.

Words are runs of bytes other than the six white-space characters of ASCII, which is what
`bytes.split()` gives.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES = 1 << 22
BATCH_ROWS = 1000
WHITE = b" \t\n\x0b\x0c\r"

_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SPACE = np.isin(np.arange(256), list(WHITE))
_VALUE = np.random.default_rng(20160101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_white_space = re.compile(rb"[ \t-\r]")
_powers = np.cumprod(np.full(64, _RADIX, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_up_to(length: int) -> np.ndarray:
    global _powers
    if _powers.size < length:
        _powers = np.cumprod(np.full(2 * length, _RADIX, dtype=np.uint64))
    return _powers


def _segments(text: bytes) -> Iterator[bytes]:
    """The text cut at white space into parts of about SEGMENT_BYTES."""
    start = 0
    while len(text) - start > SEGMENT_BYTES:
        found = _white_space.search(text, start + SEGMENT_BYTES)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _segment_words(segment: bytes, with_ends: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The hash of each word and, if asked for, its last two bytes as one number."""
    codes = np.frombuffer(segment, dtype=np.uint8)
    solid = ~_SPACE[codes]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    lengths = edges[1::2] - edges[::2]
    if not lengths.size:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    starts = np.cumsum(lengths) - lengths
    inside = codes[solid]
    place = np.arange(inside.size) - np.repeat(starts, lengths)
    terms = _VALUE[inside] * _powers_up_to(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))
    if not with_ends:
        return hashes, None
    last = edges[1::2] - 1
    before = np.where(lengths > 1, codes[last - 1], 0).astype(np.uint64)
    return hashes, before * np.uint64(256) + codes[last]


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word, in order."""
    parts = [_segment_words(segment)[0] for segment in _segments(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def words_and_ends(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, in order, and its last two bytes as one number; of a word of one byte, that byte."""
    parts = [_segment_words(segment, with_ends=True) for segment in _segments(text)]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(some) for some in zip(*parts))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of `width` words; of fewer words, one hash for all; of none, none."""
    if not words.size:
        return words
    wide = min(width, words.size)
    count = words.size - wide + 1
    total = np.full(count, wide, dtype=np.uint64)
    for k in range(wide):
        total = mix(total * _RADIX + words[k : k + count])
    return total


class PieceCache:
    """What a Python worker has learnt of short pieces of text, within a number of bytes.

    Two generations: when the newer one is full it becomes the older one, and what is asked again
    moves on. Pieces longer than LONGEST are never kept, so a text without white space leaves nothing.
    """

    LONGEST = 64
    MOST_BYTES = 96 << 20  # of both generations
    ENTRY_BYTES = 150  # of the objects and the slot that hold a piece and its value

    def __init__(self) -> None:
        self.known: dict = {}
        self._older: dict = {}
        self._held = 0

    def recalled(self, piece):
        """The value of a piece that the newer generation lacks, or None."""
        value = self._older.get(piece)
        if value is not None:
            self.keep(piece, value)
        return value

    def keep(self, piece, value) -> None:
        if len(piece) > self.LONGEST:
            return
        size = self.ENTRY_BYTES + 2 * len(piece) + (len(value) if isinstance(value, bytes) else 0)
        if self._held + size > self.MOST_BYTES // 2:
            self._older, self.known, self._held = self.known, {}, 0
        self.known[piece] = value
        self._held += size

    def table(self, wanted: set, learn) -> dict:
        """A mapping that holds the values of all wanted pieces; `learn` gives those of a set of unknown
        ones as a mapping. What is learnt at once is kept if it fits into one generation."""
        missing, older = wanted.difference(self.known), self._older
        if not missing:
            return self.known
        values = {piece: older[piece] for piece in missing if piece in older}
        values |= learn(missing.difference(values))
        short = {piece: value for piece, value in values.items() if len(piece) <= self.LONGEST}
        size = self.ENTRY_BYTES * len(short) + 2 * sum(map(len, short))
        if short and isinstance(next(iter(short.values())), bytes):
            size += sum(map(len, short.values()))
        whole, known = len(short) == len(values), self.known
        if turns := self._held + size > self.MOST_BYTES // 2:
            self._older, self.known, self._held = known, {}, 0
        if fits := size <= self.MOST_BYTES // 2:
            self.known.update(short)
            self._held += size
        if whole and fits and not turns:
            return self.known
        return values | {piece: known[piece] for piece in wanted.difference(missing)}

    def of(self, pieces, learn) -> list:
        """The values of the pieces, in order; `learn` gives those of a set of unknown ones as a mapping."""
        known, extra = self.known, {}  # stays whole when keeping turns the generations over
        for piece in (missing := set(pieces).difference(known)):
            if (value := self.recalled(piece)) is not None:
                extra[piece] = value
        learnt = learn(missing - extra.keys())
        for piece, value in learnt.items():
            self.keep(piece, value)
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:  # long pieces, or a new generation
            extra |= learnt
            return [known[piece] if piece in known else extra[piece] for piece in pieces]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The texts as UTF-8, null as empty; only a few at a time are copied out of the batch."""
    texts = batch.column(column)
    for start in range(0, len(texts), 64):
        for text in texts.slice(start, 64).cast(pa.binary()).to_pylist():
            yield text or b""


def documents(docs: DataFrame, *extra: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, extra...) of a frame of documents, whatever else it holds."""
    return docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), *extra
    )


def remainder(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `divisor`; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor, F.lit(0))


def fresh_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have."""
    taken = {name.lower() for name in frame.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def prepared(spark: SparkSession) -> SparkSession:
    """The session, set up for the queries and the pipeline.

    Python workers on the driver's machine find this package; on a cluster it is shipped with the job
    (`--py-files`). Batches handed to Python hold BATCH_ROWS documents unless the session says otherwise:
    at the default of 10,000 rows their copies, and not the work, would set an executor's memory.
    """
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return spark
