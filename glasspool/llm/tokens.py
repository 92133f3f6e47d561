"""Token counts by heap-and-linked-list byte-pair merging; no ids are formed.

A text is cut at special tokens, then into pretokens by the published pattern of byte-level BPE.
Within a pretoken the symbols form a linked list; a heap holds the ranks of adjacent pairs, and the
lowest rank (leftmost of equals) merges until none is left. The count is the number of initial
symbols less the number of merges. A pretoken of n bytes costs O(n log n), so one very long run of
letters is no trouble.

Pretokens never hold white space after other characters, so a text without non-ASCII white space is
cut at the start of each run of ASCII white space first, and the counts of such pieces are kept in a
bounded cache of the Python worker.

Defined results: null counts as empty; an empty text has no tokens; special strings inside texts
count as one token; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.llm.text import PieceCache, documents, texts_of

LIMIT = 512

# The pretoken pattern of byte-level BPE and the white space beyond ASCII in UTF-8
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_wide_space = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
_piece = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_counters: dict = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it prints, else the next
    one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class TokenCounter:
    """Counts tokens as the tokenizer file at `path` (byte-level BPE, tokenizers format) gives them."""

    def __init__(self, path: str):
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab = data["model"]["vocab"]
        self.byte_ids = [vocab[c] for c in byte_characters()]
        self.merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        special = [token["content"].encode() for token in data["added_tokens"]]
        self.special = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self.cache = PieceCache()

    @classmethod
    def of(cls, path: str) -> TokenCounter:
        """The counter of this Python worker."""
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def count(self, text: bytes) -> int:
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._ordinary, parts))

    def _ordinary(self, text: bytes) -> int:
        if _wide_space.search(text):
            return self._pretokens(text)
        pieces = _piece.findall(text)
        try:
            return sum(map(self.cache.known.__getitem__, pieces))
        except KeyError:
            return sum(self.cache.of(pieces, lambda some: {piece: self._pretokens(piece) for piece in some}))

    def _pretokens(self, text: bytes) -> int:
        found = PRETOKEN.findall(text.decode("utf-8", "replace"))
        if len(found) == 1:
            return self.merged(text)
        cache, total = self.cache, 0
        for pretoken in found:
            raw = pretoken.encode()
            count = cache.known.get(raw)
            if count is None:
                count = self.merged(raw)
                cache.keep(raw, count)
            total += count
        return total

    def merged(self, raw: bytes) -> int:
        """Symbols left of one pretoken after all merges."""
        merges, size = self.merges, len(raw)
        if size == 1:
            return 1
        symbols = [self.byte_ids[b] for b in raw]
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [
            (found[0], k, found[1], symbols[k], symbols[k + 1])
            for k in range(size - 1)
            if (found := merges.get((symbols[k], symbols[k + 1])))
        ]
        heapq.heapify(heap)
        left = size
        while heap:
            _, k, joined, first, second = heapq.heappop(heap)
            right = after[k]
            # an entry is stale once either symbol has merged
            if symbols[k] != first or right >= size or symbols[right] != second:
                continue
            symbols[k], symbols[right] = joined, -1
            after[k] = beyond = after[right]
            if beyond < size:
                before[beyond] = k
                if found := merges.get((joined, symbols[beyond])):
                    heapq.heappush(heap, (found[0], k, found[1], joined, symbols[beyond]))
            if (previous := before[k]) >= 0 and (found := merges.get((symbols[previous], joined))):
                heapq.heappush(heap, (found[0], previous, found[1], symbols[previous], joined))
            left -= 1
        return left


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of(tokenizer)
        for batch in batches:
            sizes, counts = [], []
            for text in texts_of(batch):
                sizes.append(len(text))
                counts.append(counter.count(text))
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([c > limit for c in counts], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = documents(docs, id_column=id_column, text_column=text_column)
    return narrow.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
