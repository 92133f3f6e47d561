"""Figure series over block height. Axes run from 0 to the greatest height, or to a given limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.functions import classify
from glasspool.functions.arrays import first_address
from glasspool.functions.money import amount, to_money
from glasspool.ledger import Ledger
from glasspool.operators.heights import running_totals, series_over_height, with_blockhash
from glasspool.settings import Settings

TYPE_BUCKETS = ("private", "public", "shielded", "deshielded", "mixed", "other")


def _types(ledger: Ledger, limit: int | None) -> DataFrame:
    named = {
        "private": classify.PRIVATE,
        "public": classify.PUBLIC,
        "shielded": classify.SHIELDED,
        "deshielded": classify.DESHIELDED,
        "mixed": classify.MIXED,
    }
    measures = {
        bucket: F.count_if(F.col("t_type") == type_) for bucket, type_ in named.items()
    }
    measures["other"] = F.count_if(
        F.col("t_type").isNull() | ~F.col("t_type").isin(*named.values())
    )
    rows = ledger.transaction.select(F.col("t_blockhash").alias("blockhash"), "t_type")
    return series_over_height(ledger, rows, measures, limit)


def types_per_height(ledger: Ledger, limit: int | None = None) -> DataFrame:
    """Transactions per height in six buckets; rewards and unknown types are `other`."""
    return _types(ledger, limit).select("height", *TYPE_BUCKETS)


def types_cumulative(ledger: Ledger, limit: int | None = None) -> DataFrame:
    return running_totals(_types(ledger, limit), list(TYPE_BUCKETS))


def _joinsplit_series(
    ledger: Ledger, limit: int | None, joinsplits: DataFrame, measures: dict
) -> DataFrame:
    rows = with_blockhash(ledger, joinsplits, "vj_tx_hash")
    return series_over_height(ledger, rows, measures, limit)


def pool_value_over_height(ledger: Ledger, limit: int | None = None) -> DataFrame:
    """Cumulative value held by the pool."""
    net = {"pool_value": F.sum(F.col("vj_vpub_old") - F.col("vj_vpub_new"))}
    return running_totals(
        _joinsplit_series(ledger, limit, ledger.vjoinsplit, net), ["pool_value"]
    )


def deposits_withdrawals(ledger: Ledger, limit: int | None = None) -> DataFrame:
    """Deposits and negated withdrawals per height, not cumulative."""
    flows = {"deposits": F.sum("vj_vpub_old"), "withdrawals": F.sum("vj_vpub_new")}
    series = _joinsplit_series(ledger, limit, ledger.vjoinsplit, flows)
    return series.select("height", "deposits", (-F.col("withdrawals")).alias("withdrawals"))


def identity_classes(miners: DataFrame, founders: DataFrame) -> DataFrame:
    """(address, is_miner); an address in both lists is a miner."""
    return (
        miners.select("address", F.lit(True).alias("is_miner"))
        .unionByName(founders.select("address", F.lit(False).alias("is_miner")))
        .groupBy("address")
        .agg(F.bool_or("is_miner").alias("is_miner"))
    )


IDENTITIES = ("all_value", "founders_value", "miners_value", "others_value")


def _by_identity(
    ledger: Ledger, flows: DataFrame, miners: DataFrame, founders: DataFrame, limit: int | None
) -> DataFrame:
    """Cumulative value over height by the class of each row's first address.

    `flows` is (address, value, blockhash). Rows are summed per (address, block) before the class
    is joined, so an address behind a large share of all rows is absorbed by partial sums.
    """
    per_address = flows.groupBy("address", "blockhash").agg(
        to_money(F.sum("value")).alias("value")
    )
    classed = per_address.join(identity_classes(miners, founders), "address", "left")
    is_miner, value = F.col("is_miner"), F.col("value")
    measures = {
        "all_value": F.sum(value),
        "founders_value": F.sum(F.when(~is_miner, value)),
        "miners_value": F.sum(F.when(is_miner, value)),
        "others_value": F.sum(F.when(is_miner.isNull(), value)),
    }
    series = series_over_height(ledger, classed, measures, limit)
    return running_totals(series, list(IDENTITIES))


def pool_deposits(ledger: Ledger) -> DataFrame:
    """(address, value, blockhash) of joinsplits that put value into the pool."""
    entering = ledger.vjoinsplit.filter(F.col("vj_vpub_old") > 0)
    return with_blockhash(ledger, entering, "vj_tx_hash").select(
        first_address(F.col("vj_source_address")).alias("address"),
        F.col("vj_vpub_old").alias("value"),
        "blockhash",
    )


def pool_withdrawals(ledger: Ledger) -> DataFrame:
    """(address, value, blockhash) of outputs paid by the pool alone."""
    leaving = ledger.transaction.filter(F.col("t_type") == classify.DESHIELDED).select(
        F.col("t_tx_hash").alias("vo_tx_hash"), F.col("t_blockhash").alias("blockhash")
    )
    return ledger.vout.join(leaving, "vo_tx_hash").select(
        first_address(F.col("vo_pubkey")).alias("address"),
        F.col("vo_value").alias("value"),
        "blockhash",
    )


def deposits_by_identity(
    ledger: Ledger, miners: DataFrame, founders: DataFrame, limit: int | None = None
) -> DataFrame:
    return _by_identity(ledger, pool_deposits(ledger), miners, founders, limit)


def withdrawals_by_identity(
    ledger: Ledger, miners: DataFrame, founders: DataFrame, limit: int | None = None
) -> DataFrame:
    return _by_identity(ledger, pool_withdrawals(ledger), miners, founders, limit)


def founder_correlation(
    ledger: Ledger, settings: Settings = Settings(), limit: int | None = None
) -> DataFrame:
    """Cumulative value of founder-sized deposits and of founder-sized withdrawals."""
    deposit, withdrawal = amount(settings.founder_deposit), amount(settings.founder_withdrawal)
    sized = ledger.vjoinsplit.filter(
        (F.col("vj_vpub_old") == deposit) | (F.col("vj_vpub_new") == withdrawal)
    )
    measures = {
        "deposits": F.sum(F.when(F.col("vj_vpub_old") == deposit, F.col("vj_vpub_old"))),
        "withdrawals": F.sum(F.when(F.col("vj_vpub_new") == withdrawal, F.col("vj_vpub_new"))),
    }
    return running_totals(
        _joinsplit_series(ledger, limit, sized, measures), ["deposits", "withdrawals"]
    )
