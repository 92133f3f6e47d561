"""Input resolution: what each input spends, and whose it was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.functions.money import total

_PREVOUT = ["vi_prevout_hash", "vi_prevout_n"]


def resolve_inputs(vin: DataFrame, vout: DataFrame) -> DataFrame:
    """Attach the addresses and value of the spent output; inputs that match none are dropped.

    The value is kept so that spent totals need no second join of inputs with outputs.
    """
    spent = vout.select(
        F.col("vo_tx_hash").alias("vi_prevout_hash"),
        F.col("vo_tx_n").alias("vi_prevout_n"),
        F.col("vo_pubkey").alias("vi_address"),
        F.col("vo_value").alias("vi_value"),
    )
    return vin.select("vi_tx_hash", *_PREVOUT).join(spent, _PREVOUT).select(
        "vi_tx_hash", *_PREVOUT, "vi_address", "vi_value"
    )


def total_sent(vin: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row: the value spent by the given transactions (a one-column frame of hashes)."""
    (key,) = transactions.columns
    chosen = transactions.select(F.col(key).alias("vi_tx_hash"))
    return vin.join(chosen, "vi_tx_hash", "left_semi").agg(total(F.col("vi_value")).alias("sent"))


def source_addresses(vin: DataFrame) -> DataFrame:
    """Long form (transaction, input address), one row per pair."""
    return vin.select(
        F.col("vi_tx_hash").alias("tx_hash"), F.explode("vi_address").alias("address")
    ).distinct()


def co_source_addresses(vin: DataFrame, transactions: DataFrame) -> DataFrame:
    """Distinct input addresses of the given transactions."""
    (key,) = transactions.columns
    chosen = transactions.select(F.col(key).alias("tx_hash"))
    return source_addresses(vin).join(chosen, "tx_hash", "left_semi").select("address").distinct()
