"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glasspool.llm import chat, exact, lm, merkle, minhash, negatives, packing, pii, pieces, quality, sharding, tokens, toxicity
from glasspool.llm.text import prepared
from glasspool.workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir), Workspace.of(spark), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir), Workspace.of(spark))


#: the tool that answers a user turn: its words, their number, and the turn
ASK = T.StructType(
    [
        T.StructField("text", T.StringType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("turn", T.LongType(), True),
    ]
)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call of the tool `ask`, every assistant turn as the result of the call one
    turn before. A call at an even turn of at least 2 depends on the call at half that turn, made even.
    Turns over 1,000 characters leave out the required length, so their calls are invalid. A user turn
    without conversation or number is a call without identifier."""
    turns = _table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    length = F.length("text").cast("long")
    turn = F.col("turn").cast("long")
    half = F.floor(turn / 4) * 2 + turn % 2
    calls = turns.filter("role = 'user'").select(
        "conv_id", turn.alias("turn"), name(turn).alias("call_id"), F.lit("ask").alias("name"),
        F.to_json(F.struct(turn.alias("turn"), "text", F.when(length <= 1000, length).alias("length"))).alias("arguments"),
        F.when(turn >= 2, F.array(name(half))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = turns.filter("role = 'assistant'").select(name(turn - 1).alias("call_id"), turn.alias("turn"), F.col("text").alias("content"))
    return chat.linked_calls(calls, results, {"ask": ASK}, Workspace.of(spark))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every whole text, and the text that they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.round_trip(_table(spark, sf_dir), model)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir), Workspace.of(spark), width=3, percent=85)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(_table(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir), _table(spark, sf_dir, "labels"), Workspace.of(spark))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir), Workspace.of(spark))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(_table(spark, sf_dir), Workspace.of(spark))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir), Workspace.of(spark))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved on by one before anything else."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), Workspace.of(spark), label)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir), Workspace.of(spark))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_quality, op3_chat, op4_pieces, op5_minhash, op6_tokens, op7_exact, op8_toxicity, op9_lm, op10_pii,
        op11_sharding, op12_negatives, op13_merkle,
    )
}
