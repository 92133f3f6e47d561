"""Toxic passages as maximum-scoring segments of token log-odds.

1. Tokens are words, A-Z in lower case, with marks (MARKS) as white space. Their log-odds between
   toxic and other training texts take an informative Dirichlet prior, PRIOR times the token's count
   in both (Monroe, Colaresi and Quinn, 2008); tokens whose z is not significant get 0. Less a cost
   for each token, this is a score whose mean over clean text is negative.
2. All maximal scoring segments of a text are found in one linear scan (Ruzzo and Tompa, 1999).
3. Scores are calibrated by extreme values (Karlin and Altschul, 1990): lambda solves
   sum p e^(lambda s) = 1 over the token shares of clean texts, K follows from the mean greatest
   segment of clean texts. A segment is significant if lambda S - ln(K n) > 0; the evidence of a text
   is the sum of these. A logistic curve with an L2 penalty turns evidence into a probability.

Log-odds come from two thirds of the training texts (by hash of the text), calibration from the other
third, which the log-odds have not seen; the significance level (SIGNIFICANT) and the cost (COSTS) are
those with the least log loss there.

The model is fitted on at most SAMPLE labelled rows, chosen by hash of the id; their ids are
broadcast. The model keeps at most MODEL_TOKENS tokens, those with the greatest |z|; all other
tokens are neutral. Every whole text is scored.

Defined results: null counts as empty; an empty text has no segments and gets the least probability;
a label of null is no label; a null id is never a training row; without training rows of both labels
every score is the share of toxic rows (0 without any); equal training texts count once, toxic if any
is; repeated rows are scored each; ties of z go
to the smaller hash; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.llm.text import documents, remainder, texts_of, word_hashes
from glasspool.workspace import Workspace

SAMPLE = 20_000
MODEL_TOKENS = 20_000
PRIOR = 0.1
SIGNIFICANT = (3.0, 4.0, 6.0, 9.0, 14.0)
COSTS = (0.1, 0.5, 1.0)
PENALTY = 1e-3
THRESHOLD = 0.7
MARKS = b"\"'`.,;:!?()[]{}<>|%*&$#"

_TABLE = bytes.maketrans(MARKS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(MARKS) + b"abcdefghijklmnopqrstuvwxyz")


def toxic_tokens(text: bytes) -> np.ndarray:
    return word_hashes(text.translate(_TABLE))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in order; linear in their candidates."""
    total = np.cumsum(scores)
    # each candidate: start, end, sum before it, sum at its end, last candidate with a smaller sum before
    found: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        start, left, right = at, float(total[at] - scores[at]), float(total[at])
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= left:
                k = found[k][4]
            if k < 0 or found[k][3] >= right:
                found.append((start, at + 1, left, right, k))
                break
            start, left = found[k][0], found[k][2]
            del found[k:]
    return [(start, end, right - left) for start, end, left, right, _ in found]


@dataclass
class Model:
    """Tokens in order of hash with their log-odds, and the calibration."""

    words: np.ndarray
    odds: np.ndarray
    cost: float = 0.5
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    intercept: float = -30.0
    slope: float = 0.0

    def scores(self, hashes: np.ndarray) -> np.ndarray:
        if not self.words.size:
            return np.full(hashes.size, -self.cost)
        at = np.minimum(np.searchsorted(self.words, hashes), self.words.size - 1)
        return np.where(self.words[at] == hashes, self.odds[at], 0.0) - self.cost

    def segments(self, tokens: np.ndarray) -> list[tuple[int, int, float]]:
        """The maximal segments of a text's tokens."""
        return maximal_segments(self.scores(tokens))

    def significant(self, size: int, segments: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Segments beyond what chance makes of a text of that size, with their normalised scores."""
        base = self.log_k + math.log(max(size, 1))
        return [(s, e, v) for s, e, score in segments if (v := self.rate * score - base) > 0]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * math.log1p(evidence)))))


def _solve_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum shares * e^(rate * scores) = 1."""
    low, high = 1e-6, 1.0
    value = lambda rate: float((shares * np.exp(np.minimum(rate * scores, 700))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope with an L2 penalty, by Newton's method."""
    design, w = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) / y.size + PENALTY * np.array([1e-3, 1]) * w
        curve = (design * (p * (1 - p))[:, None]).T @ design / y.size + PENALTY * np.diag([1e-3, 1.0])
        w = w - np.linalg.solve(curve, grad)
    return float(w[0]), float(w[1])


def training_texts(docs: DataFrame, labels: DataFrame, divisor: int, held_remainder: int, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled rows outside the held-out part."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(divisor) != held_remainder))
        .groupBy(F.col("doc_id").cast("long").alias("labelled"))
        .agg((F.max("toxic") > 0).alias("toxic"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(sample)
    )
    labelled = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    # copies are no evidence of their own
    return labelled.groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic")
    ).select("text", "toxic")


def _token_table(training: DataFrame) -> DataFrame:
    """(word, toxic, other): how often each token stands in texts of either label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = np.array(batch.column("toxic").to_pylist(), dtype=bool)
            texts = [toxic_tokens(text) for text in texts_of(batch)]
            if not texts:
                continue
            which = np.repeat(flags, [t.size for t in texts])
            words, inverse = np.unique(np.concatenate(texts), return_inverse=True)
            columns = [words.view(np.int64), *(np.bincount(inverse[mask], minlength=words.size) for mask in (which, ~which))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["word", "toxic", "other"])

    counted = training.mapInArrow(count, "word long, toxic long, other long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(training: DataFrame, workspace: Workspace) -> Model:
    """The model of (text, toxic)."""
    third = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(3)) == 0
    training = workspace.store(training.withColumn("calibrates", third))
    counts = _token_table(training.filter("not calibrates"))
    n1, n0 = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("other"), F.lit(0))).first()
    rows = {tuple(r)[:2]: r["count"] for r in training.groupBy("calibrates", "toxic").count().collect()}
    if len(rows) < 4 or not n1 or not n0:
        share = sum(n for (_, toxic), n in rows.items() if toxic) / max(1, sum(rows.values()))
        return Model(np.empty(0, np.uint64), np.empty(0), intercept=math.log((share + 1e-9) / (1 - share + 1e-9)))
    prior, all_prior = (F.col("toxic") + F.col("other")) * PRIOR, PRIOR * (n1 + n0)
    odds = lambda y, n: F.log((y + prior) / (n + all_prior - y - prior))
    weighed = counts.select(
        "word", "other",
        (odds(F.col("toxic"), n1) - odds(F.col("other"), n0)).alias("odds"),
        F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior)).alias("error"),
    ).withColumn("z", F.abs(F.col("odds") / F.col("error")))
    strong = (
        weighed.filter(F.col("z") >= min(SIGNIFICANT))
        .orderBy(F.desc("z"), "word")
        .limit(MODEL_TOKENS)
        .toArrow()
        .to_pandas()
    )
    strong = strong.iloc[np.argsort(strong["word"].to_numpy(dtype=np.int64).view(np.uint64))]
    models = []
    for least in SIGNIFICANT:
        part = strong[strong["z"] >= least]
        # token shares of clean texts; all tokens outside the model score -cost
        seen = (part["other"].to_numpy(dtype=np.float64) + 0.5) / n0
        for cost in COSTS:
            model = Model(part["word"].to_numpy(dtype=np.int64).view(np.uint64), part["odds"].to_numpy(dtype=np.float64), cost)
            model.rate = _solve_rate(np.append(model.odds - cost, -cost), np.append(seen, max(0.0, 1 - seen.sum())))
            models.append(model)
    calibrating = training.filter("calibrates")
    greatest = _measured(calibrating, models, lambda model, _, segments: max((s for *_, s in segments), default=0.0))
    clean = ~greatest["toxic"].to_numpy(dtype=bool)
    # the greatest segment of n tokens has mean (ln(K n) + 0.5772) / lambda
    logs = np.log(np.maximum(greatest["size"].to_numpy(dtype=np.int64)[clean], 1))
    for model, tops in zip(models, np.array(greatest["values"].tolist()).T):
        model.log_k = float(model.rate * tops[clean].mean() - 0.5772 - logs.mean())
    weighed = _measured(calibrating, models, lambda model, size, segments: sum(v for *_, v in model.significant(size, segments)))
    toxic = weighed["toxic"].to_numpy(dtype=bool)
    best = None
    for model, evidence in zip(models, np.array(weighed["values"].tolist()).T):
        model.intercept, model.slope = _fit_logistic(np.log1p(evidence), toxic.astype(np.float64))
        chance = np.clip([model.probability(e) for e in evidence], 1e-9, 1 - 1e-9)
        loss = -np.log(np.where(toxic, chance, 1 - chance)).mean()
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1]


def _measured(training: DataFrame, models: list[Model], value: Callable[[Model, int, list], float]) -> pd.DataFrame:
    """(toxic, size, values): for each training text one value of its segments under each model.

    The rows are bounded by the sample and their width by the number of models, however long the texts.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, values = [], []
            for text in texts_of(batch):
                tokens = toxic_tokens(text)
                sizes.append(tokens.size)
                values.append([float(value(model, tokens.size, model.segments(tokens))) for model in models])
            columns = [batch.column("toxic"), pa.array(sizes, pa.int64()), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "size", "values"])

    return training.mapInArrow(measure, "toxic boolean, size long, values array<double>").toArrow().to_pandas()


def toxicity(docs: DataFrame, labels: DataFrame, workspace: Workspace, divisor: int = 3, held_remainder: int = 1, threshold: float = THRESHOLD,
             id_column: str = "doc_id", text_column: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, segments), one row per document.

    `segments` are the significant passages as (first token, token after the last, normalised score).
    """
    narrow = documents(docs, id_column=id_column, text_column=text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    model = model or fit(training_texts(narrow, labels, divisor, held_remainder), workspace)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for text in texts_of(batch):
                tokens = toxic_tokens(text)
                found = model.significant(tokens.size, model.segments(tokens))
                scores.append(model.probability(sum(v for *_, v in found)))
                passages.append([{"start": s, "end": e, "score": v} for s, e, v in found])
            segment = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                       pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(passages, pa.list_(segment))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "segments"])

    schema = "doc_id long, held_out boolean, score double, predicted int, segments array<struct<start: long, end: long, score: double>>"
    return narrow.withColumn("held_out", remainder(divisor) == held_remainder).mapInArrow(judge, schema)
