"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The pieces of a model file form an automaton. Reading a text once, every output link at a position names a
piece that ends there and relaxes the best way to that position, from the best way to where the piece
starts. The score of a way is that of the model's own procedure: adjacent symbols merge in the order of
the pieces' scores, leftmost first. A link is admissible only if its piece and the last piece of the way
before it stay apart when their characters merge; a way of admissible links is what merging gives, of which
there is one, so the first admissible link, longest first, has the best score. Whether two pieces stay
apart follows from undoing their merges, latest first: they would have met if the symbols that touch ever form
a piece that ranks before the merge that took one of them. Pieces that merging never gives are left out.

Characters that are no piece fall back to their bytes and merge with nothing, so a way starts anew after
them. The ids are those of the library.

White space is written as U+2581, one stands before the text. When no piece holds U+2581 after
another character, as in models that split at white space, no piece crosses the start of a run of it;
the text is then cut there and a cache of the Python worker, bounded in bytes, keeps the ids of the parts.

The model file keeps its published pieces and scores; nothing is trained.

Defined results: null counts as empty; an empty text has no ids; control pieces are never produced
from text; repeated rows are encoded each; extra columns are ignored; decoding restores every text
without U+2581 exactly.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.llm.text import PieceCache, documents, texts_of

SPACE = "▁"
CACHED_PAIRS = 1_000_000  # of 100 bytes or so each
NOTHING = -1  # no piece: the start of a way

_part = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_coders: dict = {}


class PieceCoder:
    """Encodes and decodes with the pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.special = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        ordinary = [i for i in ids if i not in self.special and not model.is_byte(i)]
        # merges come in the order of scores; single characters are there from the start
        in_order = sorted((i for i in ordinary if len(self.pieces[i]) > 1), key=lambda i: -model.get_score(i))
        self.rank = dict.fromkeys((self.pieces[i] for i in ordinary), -1)
        self.rank |= {self.pieces[i]: rank for rank, i in enumerate(in_order)}
        self.halves: dict[str, tuple[str, str]] = {}
        kept = [i for i in ordinary if len(self.pieces[i]) == 1]
        #: pieces with a half that ranks after them: their merges cannot be undone in the order of ranks
        self.irregular: set[str] = set()
        for i in in_order:
            piece = self.pieces[i]
            symbols, halves = self.merged(piece)
            if len(symbols) > 1:
                continue
            kept.append(i)
            self.halves[piece] = halves
            if any(self.rank[half] > self.rank[piece] or half in self.irregular for half in halves):
                self.irregular.add(piece)
        self.automaton = ahocorasick.Automaton()
        for i in kept:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        self.separable = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in kept)
        self.apart: dict[tuple[int, int], bool] = {}
        self.cache = PieceCache()

    @classmethod
    def of(cls, path: str) -> PieceCoder:
        """The coder of this Python worker."""
        if path not in _coders:
            _coders[path] = cls(path)
        return _coders[path]

    def merged(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """The symbols that merging leaves of a short text, and the halves of the last merge."""
        symbols, halves = list(text), ("", "")
        while len(symbols) > 1:
            ranks = [self.rank.get(a + b, -1) for a, b in zip(symbols, symbols[1:])]
            best = min((rank for rank in ranks if rank >= 0), default=-1)
            if best < 0:
                break
            at = ranks.index(best)
            halves = symbols[at], symbols[at + 1]
            symbols[at : at + 2] = ["".join(halves)]
        return symbols, halves

    def stay_apart(self, left: int, right: int) -> bool:
        """Does merging the characters of two pieces give the two again?"""
        x, y = self.pieces[left], self.pieces[right]
        if x in self.irregular or y in self.irregular:
            return self.merged(x + y)[0] == [x, y]
        rank, limit = self.rank, len(self.rank)
        while True:
            if 0 <= rank.get(x + y, limit) < limit:
                return False
            if rank[x] > rank[y]:
                # equal merges run from the left, so one that touches this one from the right comes later
                limit = rank[x]
                x = self.halves[x][1]
            elif rank[y] >= 0:
                limit = rank[y] + 1
                y = self.halves[y][0]
            else:
                return True

    def _admissible(self, left: int, right: int) -> bool:
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) >= CACHED_PAIRS:
                self.apart.clear()
            found = self.apart[left, right] = self.stay_apart(left, right)
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.separable:
            return self.viterbi(marked)
        parts = _part.findall(marked)
        try:
            return b"".join(map(self.cache.known.__getitem__, parts))
        except KeyError:
            return b"".join(self.cache.of(parts, lambda some: {part: self.viterbi(part) for part in some}))

    def viterbi(self, text: str) -> bytes:
        """The segmentation of a text whose white space is marked."""
        size = len(text)
        last = [NOTHING] * (size + 1)  # the piece that ends the best way to a position
        admissible = self._admissible
        position = 0
        for end, (length, piece) in self.automaton.iter(text):
            if end + 1 != position:
                position, open_ = end + 1, True
            # links come longest first; the first admissible one is the best
            if open_:
                before = last[position - length]
                if before == NOTHING or admissible(before, piece):
                    last[position], open_ = piece, False
        ids, at = [], size
        while at:
            piece = last[at]
            if piece == NOTHING:
                at -= 1
                ids.extend(self.byte_ids[b] for b in reversed(text[at].encode("utf-8", "replace")))
            else:
                at -= len(self.pieces[piece])
                ids.append(piece)
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids; control pieces are dropped."""
        out, pending = [], bytearray()
        for i in np.frombuffer(ids, dtype="<u4").tolist():
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            if i not in self.special:
                out.append(self.pieces[i])
        out.append(pending.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids), one row per document; the ids are 32-bit numbers as bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.of(model)
        for batch in batches:
            sizes, ids = [], []
            for raw in texts_of(batch):
                text = raw.decode("utf-8", "replace")
                sizes.append(len(text))
                ids.append(coder.encode(text))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                       pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "n_pieces", "ids"])

    narrow = documents(docs, id_column=id_column, text_column=text_column)
    return narrow.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        encode, "doc_id long, n_chars long, n_pieces long, ids binary"
    )


def round_trip(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids_crc32, text_sha256): the ids, and the text that they decode to.

    Encoded and decoded where the text is, so no ids travel."""

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.of(model)
        for batch in batches:
            sizes, counts, sums, digests = [], [], [], []
            for raw in texts_of(batch):
                text = raw.decode("utf-8", "replace")
                ids = coder.encode(text)
                sizes.append(len(text))
                counts.append(len(ids) // 4)
                sums.append(zlib.crc32(ids))
                digests.append(hashlib.sha256(coder.decode(ids).encode("utf-8", "replace")).hexdigest())
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, counts, sums)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "n_pieces", "ids_crc32", "text_sha256"])

    narrow = documents(docs, id_column=id_column, text_column=text_column)
    return narrow.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        there_and_back, "doc_id long, n_chars long, n_pieces long, ids_crc32 long, text_sha256 string"
    )


def decoded(frame: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of a frame with `ids`, as `encoded` gives them."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.of(model)
        for batch in batches:
            texts = [coder.decode(x.as_py() or b"") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return frame.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
