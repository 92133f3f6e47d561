"""Per-address statistics, rich lists and single-address profiles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspool.functions.arrays import (
    address_key,
    first_address_or_blank,
    singleton_or_blank,
)
from glasspool.functions.classify import DESHIELDED
from glasspool.functions.labels import row_label, stitched_address
from glasspool.functions.money import amount, difference, total
from glasspool.ledger import Ledger
from glasspool.operators.heights import transaction_heights
from glasspool.operators.joins import reshuffled
from glasspool.operators.positions import previous, running_sum
from glasspool.schema import MONEY
from glasspool.settings import ACTIVE_GAP, FOUNDERS_REWARD, RICH_LIST_SIZE
from glasspool.workspace import Workspace

_ZERO = Decimal(0)


def value_received(vout: DataFrame) -> DataFrame:
    return vout.groupBy(address_key(F.col("vo_pubkey")).alias("address")).agg(
        total(F.col("vo_value")).alias("recv")
    )


def value_sent(vin: DataFrame) -> DataFrame:
    return vin.groupBy(address_key(F.col("vi_address")).alias("address")).agg(
        total(F.col("vi_value")).alias("sent")
    )


def _leg(rows: DataFrame, side: str, addresses: str, tx: str, value: str) -> DataFrame:
    """Rows of one side of the ledger. Only outputs can be coinbase or paid by the pool."""
    return rows.select(
        address_key(F.col(addresses)).alias("address"),
        F.col(tx).alias("tx_hash"),
        F.lit(side).alias("side"),
        F.col(value).alias("value"),
        *(
            F.col(flag) if flag in rows.columns else F.lit(False).alias(flag)
            for flag in ("is_coinbase", "is_leaving")
        ),
    )


def _output_leg(ledger: Ledger) -> DataFrame:
    yes, no = F.lit(True), F.lit(False)
    coinbase = ledger.coingen.select(
        F.col("c_tx_hash").alias("vo_tx_hash"), yes.alias("is_coinbase"), no.alias("is_leaving")
    )
    leaving = ledger.transaction.filter(F.col("t_type") == DESHIELDED).select(
        F.col("t_tx_hash").alias("vo_tx_hash"), no.alias("is_coinbase"), yes.alias("is_leaving")
    )
    flags = (
        coinbase.unionByName(leaving)
        .groupBy("vo_tx_hash")
        .agg(
            F.bool_or("is_coinbase").alias("is_coinbase"),
            F.bool_or("is_leaving").alias("is_leaving"),
        )
        .transform(reshuffled, "vo_tx_hash")
    )
    marked = ledger.vout.join(flags, "vo_tx_hash", "left").na.fill(
        False, ["is_coinbase", "is_leaving"]
    )
    return _leg(marked, "out", "vo_pubkey", "vo_tx_hash", "vo_value")


def _deposit_leg(ledger: Ledger) -> DataFrame:
    """Deposits that can be told apart: joinsplits with exactly one source address."""
    single = ledger.vjoinsplit.filter(F.size("vj_source_address") == 1)
    return _leg(single, "pool", "vj_source_address", "vj_tx_hash", "vj_vpub_old")


def address_stats(ledger: Ledger, parity: bool = False) -> DataFrame:
    """One row per address key with values, counts and pool flows.

    The rows of all legs are summed per (address, transaction, side) and then per address, so
    distinct transactions are plain counts, and an address with very many rows is spread over its
    transactions before its partial sums are gathered. `parity=True` gives 0 total transactions
    to addresses active on one side only.
    """
    legs = (
        _output_leg(ledger)
        .unionByName(_leg(ledger.vin, "in", "vi_address", "vi_tx_hash", "vi_value"))
        .unionByName(_deposit_leg(ledger))
    )
    per_transaction = legs.groupBy("address", "tx_hash", "side").agg(
        F.sum("value").alias("value"),
        F.count(F.lit(1)).alias("rows"),
        F.bool_or("is_coinbase").alias("is_coinbase"),
        F.bool_or("is_leaving").alias("is_leaving"),
    )
    value, rows = F.col("value"), F.col("rows")
    out, in_ = F.col("side") == "out", F.col("side") == "in"
    zero = F.lit(0).cast("bigint")

    def value_of(condition: Column) -> Column:
        return total(F.when(condition, value))

    def rows_of(condition: Column) -> Column:
        return F.sum(F.when(condition, rows).otherwise(zero))

    stats = per_transaction.groupBy("address").agg(
        value_of(out).alias("recv"),
        value_of(in_).alias("sent"),
        value_of(F.col("side") == "pool").alias("pool_sent"),
        value_of(F.col("is_leaving")).alias("pool_recv"),
        rows_of(out).alias("vouts_count"),
        rows_of(in_).alias("vins_count"),
        rows_of(F.col("is_coinbase")).alias("coingens_recv"),
        F.count_if(in_).alias("txs_sent"),
        F.count_if(out).alias("txs_recv"),
    )
    both = F.col("txs_sent") + F.col("txs_recv")
    if parity:
        both = F.when((F.col("txs_sent") > 0) & (F.col("txs_recv") > 0), both).otherwise(zero)
    return stats.select(
        "address",
        "recv",
        "sent",
        difference(F.col("recv"), F.col("sent")).alias("current_value"),
        "txs_sent",
        "txs_recv",
        "vins_count",
        "vouts_count",
        both.alias("no_txs_total"),
        "coingens_recv",
        "pool_sent",
        "pool_recv",
    )


def transaction_counts(ledger: Ledger) -> DataFrame:
    """(address, txs_sent, txs_recv): distinct transactions on each side."""
    received = ledger.vout.select(
        address_key(F.col("vo_pubkey")).alias("address"),
        F.col("vo_tx_hash").alias("tx_hash"),
        F.lit(False).alias("sends"),
    )
    sent = ledger.vin.select(
        address_key(F.col("vi_address")).alias("address"),
        F.col("vi_tx_hash").alias("tx_hash"),
        F.lit(True).alias("sends"),
    )
    return (
        received.unionByName(sent)
        .distinct()
        .groupBy("address")
        .agg(
            F.count_if(F.col("sends")).alias("txs_sent"),
            F.count_if(~F.col("sends")).alias("txs_recv"),
        )
    )


def row_counts(ledger: Ledger) -> DataFrame:
    """(address, vins_count, vouts_count): input and output rows."""
    legs = ledger.vout.select(
        address_key(F.col("vo_pubkey")).alias("address"), F.lit(False).alias("spends")
    ).unionByName(
        ledger.vin.select(
            address_key(F.col("vi_address")).alias("address"), F.lit(True).alias("spends")
        )
    )
    return legs.groupBy("address").agg(
        F.count_if(F.col("spends")).alias("vins_count"),
        F.count_if(~F.col("spends")).alias("vouts_count"),
    )


def coinbase_outputs(ledger: Ledger) -> DataFrame:
    """Outputs of coinbase transactions."""
    coinbase = ledger.coingen.select(F.col("c_tx_hash").alias("vo_tx_hash"))
    return ledger.vout.join(coinbase, "vo_tx_hash", "left_semi")


def coinbase_counts(ledger: Ledger) -> DataFrame:
    """(address, coingens_recv): coinbase output rows per address key."""
    return coinbase_outputs(ledger).groupBy(address_key(F.col("vo_pubkey")).alias("address")).agg(
        F.count(F.lit(1)).alias("coingens_recv")
    )


def pool_outputs(ledger: Ledger) -> DataFrame:
    """Outputs of transactions fed by the pool alone."""
    leaving = ledger.transaction.filter(F.col("t_type") == DESHIELDED).select(
        F.col("t_tx_hash").alias("vo_tx_hash")
    )
    return ledger.vout.join(leaving, "vo_tx_hash", "left_semi")


def pool_flows(ledger: Ledger) -> DataFrame:
    """(address, pool_sent, pool_recv), 0 where a side is missing."""
    leaving = pool_outputs(ledger).select(
        address_key(F.col("vo_pubkey")).alias("address"),
        amount(_ZERO).alias("pool_sent"),
        F.col("vo_value").alias("pool_recv"),
    )
    entering = ledger.vjoinsplit.filter(F.size("vj_source_address") == 1).select(
        address_key(F.col("vj_source_address")).alias("address"),
        F.col("vj_vpub_old").alias("pool_sent"),
        amount(_ZERO).alias("pool_recv"),
    )
    return leaving.unionByName(entering).groupBy("address").agg(
        total(F.col("pool_sent")).alias("pool_sent"), total(F.col("pool_recv")).alias("pool_recv")
    )


def stitched_rows(ledger: Ledger) -> DataFrame:
    """Output and input address sets paired by equality, with both flattenings and the label."""
    received = ledger.vout.groupBy("vo_pubkey").agg(total(F.col("vo_value")).alias("recv"))
    sent = ledger.vin.groupBy("vi_address").agg(total(F.col("vi_value")).alias("sent"))
    stitched = received.join(sent, F.col("vo_pubkey") == F.col("vi_address"), "full_outer")
    output_flat = singleton_or_blank(F.col("vo_pubkey"))
    input_flat = singleton_or_blank(F.col("vi_address"))
    return stitched.select(
        "vo_pubkey",
        "vi_address",
        output_flat.alias("output_address"),
        input_flat.alias("input_address"),
        first_address_or_blank(F.col("vo_pubkey")).alias("first_output"),
        row_label(output_flat, input_flat).alias("label"),
        stitched_address(F.col("vi_address"), F.col("vo_pubkey")).alias("stitched"),
        F.coalesce("recv", F.lit(0)).cast("decimal(38,8)").alias("recv"),
        F.coalesce("sent", F.lit(0)).cast("decimal(38,8)").alias("sent"),
    )


def rich_list(stats: DataFrame, measure: str, size: int = RICH_LIST_SIZE) -> DataFrame:
    """The `size` addresses with the greatest `measure`; ties by address."""
    return (
        stats.filter(F.col("address") != "")
        .select("address", measure)
        .orderBy(F.desc(measure), "address")
        .limit(size)
    )


_TALLIES = (
    "txs_sent",
    "txs_recv",
    "coingens",
    "blocks_mined",
    "joinsplits_in",
    "joinsplits_out",
    "entering",
    "leaving",
)
_AMOUNTS = ("total_shielded", "total_deshielded", "total_received", "total_sent")


def _activity(ledger: Ledger, addresses: DataFrame | str) -> DataFrame:
    """(address, tx_hash, side, value) of the given address (a string) or addresses (a frame)."""

    def held(rows: DataFrame, side: str, owner: str, tx: str, value: str) -> DataFrame:
        kept = (F.col(tx).alias("tx_hash"), F.col(value).alias("value"), F.lit(side).alias("side"))
        if isinstance(addresses, str):
            return rows.filter(F.array_contains(owner, addresses)).select(
                F.lit(addresses).alias("address"), *kept
            )
        return rows.select(F.explode(F.array_distinct(owner)).alias("address"), *kept)

    legs = held(ledger.vout, "recv", "vo_pubkey", "vo_tx_hash", "vo_value").unionByName(
        held(ledger.vin, "sent", "vi_address", "vi_tx_hash", "vi_value")
    )
    if not isinstance(addresses, str):
        # before the sums, so that a short list does not sum up the whole ledger
        wanted = addresses.select("address").distinct()
        legs = legs.join(reshuffled(wanted, "address"), "address", "left_semi")
        # else the sums would take over the join's partitioning and keep a hot address in one task
        legs = reshuffled(legs, "address")
    return legs.groupBy("address", "tx_hash", "side").agg(total(F.col("value")).alias("value"))


def address_profile(
    ledger: Ledger,
    addresses: DataFrame | str,
    founders_reward: Decimal = FOUNDERS_REWARD,
) -> DataFrame:
    """Activity of one address, or of each address of a frame; one row per active address.

    `joinsplits_in_ok` / `joinsplits_out_ok` say whether every joinsplit counted on that side
    moves value in that direction; the shielded and deshielded totals are only meaningful then.
    """
    facts = _activity(ledger, addresses)
    is_recv, is_sent = F.col("side") == "recv", F.col("side") == "sent"
    zero = F.lit(0)

    def measures(rows: DataFrame, **values: Column) -> DataFrame:
        counts = {name: values.get(name, zero).cast("bigint") for name in _TALLIES}
        amounts = {name: values.get(name, amount(_ZERO)).cast("decimal(38,8)") for name in _AMOUNTS}
        return rows.select(
            "address", *(column.alias(name) for name, column in (counts | amounts).items())
        )

    def value_if(condition: Column, value: str) -> Column:
        return F.when(condition, F.col(value)).otherwise(amount(_ZERO))

    def count_if(condition: Column, counted: str) -> Column:
        return F.when(condition, F.col(counted)).otherwise(zero)

    # one row for each transaction and kind: whichever side is small, usually the activity, can be
    # broadcast, and an address never meets the joinsplits of a transaction one by one
    nothing = amount(_ZERO).cast("decimal(38,8)")
    coinbases = ledger.coingen.groupBy(F.col("c_tx_hash").alias("tx_hash")).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.lit(0)).alias("entering_events"),
        F.sum(F.lit(0)).alias("leaving_events"),
        F.max(nothing).alias("old"),
        F.max(nothing).alias("new"),
    )
    joinsplits = ledger.vjoinsplit.groupBy(F.col("vj_tx_hash").alias("tx_hash")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("vj_vpub_old") > 0).alias("entering_events"),
        F.count_if(F.col("vj_vpub_new") > 0).alias("leaving_events"),
        total(F.col("vj_vpub_old")).alias("old"),
        total(F.col("vj_vpub_new")).alias("new"),
    )
    events = coinbases.withColumn("is_coinbase", F.lit(True)).unionByName(
        joinsplits.withColumn("is_coinbase", F.lit(False))
    )
    met = facts.join(reshuffled(events, "tx_hash"), "tx_hash")
    mints = is_recv & F.col("is_coinbase")
    enters, leaves = is_sent & ~F.col("is_coinbase"), is_recv & ~F.col("is_coinbase")
    tallied = measures(
        facts,
        txs_sent=is_sent.cast("bigint"),
        txs_recv=is_recv.cast("bigint"),
        total_received=value_if(is_recv, "value"),
        total_sent=value_if(is_sent, "value"),
    ).unionByName(
        measures(
            met,
            coingens=count_if(mints, "events"),
            blocks_mined=count_if(mints & (F.col("value") != amount(founders_reward)), "events"),
            joinsplits_in=count_if(enters, "events"),
            joinsplits_out=count_if(leaves, "events"),
            entering=count_if(enters, "entering_events"),
            leaving=count_if(leaves, "leaving_events"),
            total_shielded=value_if(enters, "old"),
            total_deshielded=value_if(leaves, "new"),
        )
    )
    profile = tallied.groupBy("address").agg(
        *(F.sum(name).alias(name) for name in _TALLIES),
        *(total(F.col(name)).alias(name) for name in _AMOUNTS),
    )
    heights = ledger.block.agg(
        F.min("b_height").alias("from_height"), F.max("b_height").alias("to_height")
    )
    return profile.select(
        "address",
        heights.select("from_height").scalar().alias("from_height"),
        heights.select("to_height").scalar().alias("to_height"),
        "txs_sent",
        "txs_recv",
        "coingens",
        "blocks_mined",
        "joinsplits_in",
        "total_shielded",
        "joinsplits_out",
        "total_deshielded",
        "total_received",
        "total_sent",
        difference(F.col("total_received"), F.col("total_sent")).alias("remaining"),
        (F.col("joinsplits_in") == F.col("entering")).alias("joinsplits_in_ok"),
        (F.col("joinsplits_out") == F.col("leaving")).alias("joinsplits_out_ok"),
    )


def profile_co_sources(ledger: Ledger, address: str) -> DataFrame:
    """Distinct addresses that were inputs of the transactions `address` sent, itself included."""
    return (
        ledger.vin.join(
            ledger.vin.filter(F.array_contains("vi_address", address)).select("vi_tx_hash"),
            "vi_tx_hash",
            "left_semi",
        )
        .select(F.explode("vi_address").alias("address"))
        .distinct()
    )


def balance_changes(ledger: Ledger) -> DataFrame:
    """(address, height, change): what each address key gains or loses at each height that names it.

    Legs are summed per transaction before heights are joined, so neither a hot address nor a hot
    transaction meets the join row by row.
    """

    def side(rows: DataFrame, owner: str, tx: str, value: Column) -> DataFrame:
        return rows.select(address_key(F.col(owner)).alias("address"), F.col(tx).alias("tx_hash"), value.alias("change"))

    per_transaction = (
        side(ledger.vout, "vo_pubkey", "vo_tx_hash", F.col("vo_value"))
        .unionByName(side(ledger.vin, "vi_address", "vi_tx_hash", -F.col("vi_value")))
        .groupBy("address", "tx_hash")
        .agg(total(F.col("change")).alias("change"))
    )
    heights = transaction_heights(ledger).select("tx_hash", "height")
    return per_transaction.join(heights, "tx_hash").groupBy("address", "height").agg(
        F.sum("change").cast("decimal(38,8)").alias("change")
    )


def address_balances(ledger: Ledger, workspace: Workspace) -> DataFrame:
    """(address, height, balance): the balance after each height at which the address is named.

    Prefix sums over ranges of (address, height): an address with a third of all heights is spread over
    as many tasks as they fill.
    """
    moves = running_sum(balance_changes(ledger), ["address"], ["height"], "change", "balance", workspace)
    return moves.select("address", "height", F.col("balance").cast("decimal(38,8)").alias("balance"))


def active_ranges(ledger: Ledger, workspace: Workspace, gap: int = ACTIVE_GAP) -> DataFrame:
    """(address, first_height, last_height, active_heights): stretches in which the address is never silent
    for more than `gap` blocks.

    A height starts a stretch if the one before it is too far away, in whatever range of rows that one lies;
    stretches are told apart by the running number of such starts.
    """
    active = balance_changes(ledger).select("address", "height")
    before = previous(active, ["address"], ["height"], "height", "last", workspace)
    starts = before.withColumn("start", F.when(F.col("height") - F.col("last") <= gap, 0).otherwise(1))
    numbered = running_sum(starts, ["address"], ["height"], "start", "stretch", workspace)
    return numbered.groupBy("address", "stretch").agg(
        F.min("height").alias("first_height"), F.max("height").alias("last_height"), F.count(F.lit(1)).alias("active_heights")
    ).drop("stretch")
