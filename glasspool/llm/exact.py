"""Exact deduplication by two passes over a Bloom filter, in DataFrame operations only.

The first pass counts how often each cell of a register-blocked Bloom filter is hit (a cell is a
64-bit word and two bits of it, taken from the hash of the text); the cells hit more than once
make the filter of possibly repeated hashes. The second pass probes it with every row: a row whose
bits are not both set has no copy and passes straight through, without a shuffle. Only the other
rows are grouped by SHA-256 of the text and shuffled.

The filter is broadcast. It has one row for each non-empty word and at most `most_words` of them
(2**22 by default: 64 MB of rows). Beyond some 2**23 repeated texts it fills up, and more of the rows
without copies shuffle; the result stays the same.

Defined results: a null text counts as empty; rows with a null id count in their group and are
kept only if no id of the group is known; rows equal in id and text are one document and share the
decision; extra columns are carried along by `drop_copies`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.llm.bloom import MOST_WORDS, cell, filled, filter_words, held
from glasspool.operators.joins import reshuffled

def _probed(docs: DataFrame, id_column: str, text_column: str, most_words: int) -> DataFrame:
    """(row, id, text, maybe): `maybe` is false only for texts that occur once."""
    words = filter_words(docs.count(), most_words)
    word, mask = cell(F.col("hash"), words)
    hashed = docs.select(
        F.struct("*").alias("row"),
        F.col(id_column).alias("id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    ).withColumn("hash", F.xxhash64("text"))
    cells = hashed.withColumns({"word": word, "mask": mask})
    hits = cells.groupBy("word", "mask").agg(F.count("*").alias("hits"))
    repeated = filled(hits.filter("hits > 1"))
    return cells.join(F.broadcast(repeated), "word", "left").select(
        "row", "id", "text", held(F.col("bits"), F.col("mask")).alias("maybe")
    )


def _decided(docs: DataFrame, id_column: str, text_column: str, most_words: int) -> DataFrame:
    """(row, keep_id, group_size, kept, text_sha256) for every row."""
    probed = _probed(docs, id_column, text_column, most_words)
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    alone = probed.filter(~F.col("maybe")).select(
        "row",
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        digest,
    )
    candidates = probed.filter("maybe").select("row", "id", digest)
    groups = (
        candidates.groupBy("text_sha256")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .transform(reshuffled, "text_sha256")
    )
    met = candidates.join(groups, "text_sha256").select(
        "row", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(met)


def duplicate_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_words: int = MOST_WORDS
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document.

    Of equal texts the row with the largest id stays.
    """
    narrow = docs.select(id_column, text_column)
    return _decided(narrow, id_column, text_column, most_words).select(
        F.col("row").getField(id_column).alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def drop_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_words: int = MOST_WORDS
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    return _decided(docs, id_column, text_column, most_words).filter("kept").select("row.*")
