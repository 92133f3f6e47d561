"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

Each document is measured by ratios in whole thousandths. A sketch of a ratio is a histogram with
buckets of a relative width of at most 1/32 (the five bits below the highest one are kept), so
sketches of parts merge by adding counts; that is an aggregate with partial sums in each task, and
a hot source costs no more than another. Quartiles of the group (language, source) give fences

    high = q75 + 3 * max(q75 - q50, slack)      low = q25 - 3 * max(q50 - q25, slack)

in place of fixed cutoffs; `slack` keeps a group without spread from rejecting everything. Groups
of under LEAST_GROUP documents take the merged sketch of their language, and languages of under
LEAST_GROUP documents that of all documents. The fences are written as a table, so that a repeated
task decides alike, and are joined to the documents.

Base rule (`base_failed`): under 50 words, or over half of the words in repeated 3-word windows.

Defined results: a null or empty text has no words and fails the base rule; a null language or
source is the group ''; repeated rows are measured each and decided alike; extra columns are
carried along by `keep_good`, whatever their names; ties lie inside the fence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from glasspool.llm.text import WHITE, documents, fresh_name, texts_of, window_hashes, word_hashes
from glasspool.operators.joins import reshuffled
from glasspool.workspace import Workspace

LEAST_WORDS = 50
LEAST_GROUP = 200
SPREADS = 3
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: ratio: numerator, denominator, slack in thousandths, is there a lower fence
RATIOS = {
    "word_length": ("word_chars", "n_words", 500, True),
    "symbols": ("n_symbols", "n_words", 50, False),
    "dup_lines": ("n_dup_lines", "n_lines", 100, False),
    "repeats": ("n_repeat_words", "n_words", 50, False),
    "upper": ("n_upper", "word_chars", 50, False),
}


def measure(text: bytes) -> tuple[int, ...]:
    """The COUNTS of one text."""
    words = word_hashes(text)
    solid = text.translate(None, WHITE)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        words.size,
        len(solid.decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def _repeated(words: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    if words.size <= width:
        return 0
    windows = window_hashes(words, width)
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not again.size:
        return 0
    found = np.isin(windows, again)
    covered = np.zeros(words.size, dtype=bool)
    for k in range(width):
        covered[k : k + windows.size] |= found
    return int(covered.sum())


def with_counts(docs: DataFrame, text_column: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """`docs` with a struct of COUNTS, and the name of that column."""
    name = fresh_name(docs, "counts")
    kept = [c for c in docs.columns if keep_text or c != text_column]
    fields = [T.StructField(c, T.LongType(), False) for c in COUNTS]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.StructType(fields), False)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*map(measure, texts_of(batch, text_column))) if batch.num_rows else [()] * len(COUNTS)
            counts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [counts], names=[*kept, name])

    return docs.mapInArrow(measured, schema), name


def _ratio(counts: str, ratio: str) -> Column:
    over, under, _, _ = RATIOS[ratio]
    part, whole = (F.col(f"{counts}.{c}") for c in (over, under))
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0).cast("long")


def bucket(value: Column) -> Column:
    """The least value of the sketch bucket of a whole number of 0 or more."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(counted: DataFrame, counts: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, ratio, bucket, n): the mergeable sketch of each ratio over sound documents."""
    rows = counted.filter(~base_failed(counts)).select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(r).alias("ratio"), bucket(_ratio(counts, r)).alias("bucket"))
                    for r in RATIOS
                )
            )
        ),
    )
    return rows.groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n"))


def base_failed(counts: str) -> Column:
    words = F.col(f"{counts}.n_words")
    return (words < LEAST_WORDS) | (F.col(f"{counts}.n_repeat_words") * 100 > words * 50)


def _quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, size, q25, q50, q75) of merged sketches."""
    merged = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    running = Window.partitionBy(*keys).orderBy("bucket")
    placed = merged.withColumns(
        {"upto": F.sum("n").over(running), "size": F.sum("n").over(Window.partitionBy(*keys))}
    )
    return placed.groupBy(*keys).agg(
        F.max("size").alias("size"),
        *(
            F.min(F.when(F.col("upto") * 100 >= F.col("size") * q, F.col("bucket"))).alias(f"q{q}")
            for q in (25, 50, 75)
        ),
    )


def fences(sketch: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """(lang, source, {ratio: low, high}): one row for each group of the sketch."""
    groups = _quartiles(sketch, "lang", "source", "ratio")
    langs, whole = _quartiles(sketch, "lang", "ratio"), _quartiles(sketch, "ratio")

    def told(frame: DataFrame, name: str) -> DataFrame:
        keys = [c for c in ("lang", "source", "ratio") if c in frame.columns]
        return frame.select(*keys, F.struct("size", "q25", "q50", "q75").alias(name))

    large = lambda name: F.when(F.col(f"{name}.size") >= least_group, F.col(name))
    chosen = (
        told(groups, "own")
        .join(told(langs, "by_lang"), ["lang", "ratio"])
        .join(told(whole, "by_all"), "ratio")
        .select("lang", "source", "ratio", F.coalesce(large("own"), large("by_lang"), "by_all").alias("q"))
    )
    bounds = []
    for ratio, (_, _, slack, two_sided) in RATIOS.items():
        here = F.col("ratio") == ratio
        wide = F.greatest(F.col("q.q75") - F.col("q.q50"), F.lit(slack))
        deep = F.greatest(F.col("q.q50") - F.col("q.q25"), F.lit(slack))
        bounds.append(F.max(F.when(here, F.col("q.q75") + SPREADS * wide)).alias(f"{ratio}_high"))
        if two_sided:
            bounds.append(F.max(F.when(here, F.col("q.q25") - SPREADS * deep)).alias(f"{ratio}_low"))
    return chosen.groupBy("lang", "source").agg(*bounds)


def _judged(counted: DataFrame, counts: str, table: DataFrame, lang: str, source: str) -> DataFrame:
    """`counted` joined with its fences: columns base_failed and kept."""
    row, group = F.struct(*counted.columns).alias("row"), "group"
    name = lambda a, b: F.to_json(F.array(a, b))
    keyed = counted.select(
        row,
        name(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source))).alias(group),
    )
    bounds = table.select(name("lang", "source").alias(group), *(c for c in table.columns if c not in ("lang", "source")))
    passed = F.lit(True)
    for ratio, (_, _, _, two_sided) in RATIOS.items():
        value = _ratio(f"row.{counts}", ratio)
        passed &= value <= F.col(f"{ratio}_high")
        if two_sided:
            passed &= value >= F.col(f"{ratio}_low")
    failed = base_failed(f"row.{counts}")
    # a group whose documents all fail the base rule has no fences
    return keyed.join(reshuffled(bounds, group), group, "left").select(
        "row", failed.alias("base_failed"), (~failed & F.coalesce(passed, F.lit(False))).alias("kept")
    )


def judge(docs: DataFrame, workspace: Workspace, id_column: str = "doc_id", text_column: str = "text",
          lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept), one row per document."""
    narrow = documents(docs, F.col(lang).alias("lang"), F.col(source).alias("source"),
                       id_column=id_column, text_column=text_column)
    counted, counts = with_counts(narrow, keep_text=False)
    stored = workspace.store(counted)
    table = workspace.store(fences(sketches(stored, counts)))
    judged = _judged(stored, counts, table, "lang", "source")
    return judged.select("row.doc_id", f"row.{counts}.*", "base_failed", "kept")


def keep_good(docs: DataFrame, workspace: Workspace, text_column: str = "text",
              lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `docs` that pass, with all their columns. The texts are measured twice, not shuffled
    unless there are too many groups for Spark to broadcast their fences."""
    narrow = documents(docs, F.col(lang).alias("lang"), F.col(source).alias("source"),
                       id_column=text_column, text_column=text_column)
    counted, counts = with_counts(narrow.select("text", "lang", "source"), keep_text=False)
    table = workspace.store(fences(sketches(counted, counts)))
    whole, counts = with_counts(docs, text_column)
    judged = _judged(whole, counts, table, lang, source)
    return judged.filter("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
