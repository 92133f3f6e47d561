"""Staging tables to clean tables: pruning, renaming, the height limit and its cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspool import schema
from glasspool.functions.money import to_money
from glasspool.ledger import Ledger
from glasspool.operators.enrichment import with_joinsplit_addresses
from glasspool.operators.inputs import resolve_inputs
from glasspool.workspace import Workspace

# Prefix of each clean table; clean columns are the staging columns behind it.
_PREFIX = {
    "transaction": "t_",
    "block": "b_",
    "coingen": "c_",
    "vin": "vi_",
    "vout": "vo_",
    "vjoinsplit": "vj_",
}
_UNRESOLVED = {**schema.CLEAN, "vin": schema.VIN}


def _clean_column(staged: str, target: str, kind) -> Column:
    if kind == schema.MONEY:
        return to_money(F.col(staged)).alias(target)
    return F.col(staged).cast(kind).alias(target)


def clean_columns(table: str, staged: DataFrame) -> DataFrame:
    """Keep the columns the analyses use, under their prefixed names and declared types."""
    prefix = _PREFIX[table]
    return staged.select(
        *(
            _clean_column(field.name.removeprefix(prefix), field.name, field.dataType)
            for field in _UNRESOLVED[table].fields
        )
    )


def limit_height(
    tables: dict[str, DataFrame], height_limit: int | None, genesis_tx: str | None = None
) -> dict[str, DataFrame]:
    """Blocks up to the limit, their transactions, and the rows of those transactions.

    The hashes of the blocks are written, without the listings, so that Spark sees their size and does not
    shuffle the transactions for each table to meet few blocks.
    """
    block = tables["block"]
    transaction = tables["transaction"]
    if height_limit is not None:
        block = block.filter(F.col("b_height") <= height_limit)
    if genesis_tx is not None:
        transaction = transaction.filter(F.col("t_tx_hash") != genesis_tx)
    kept_blocks = Workspace.of(block.sparkSession).store(block.select(F.col("b_hash").alias("t_blockhash")))
    transaction = transaction.join(kept_blocks, "t_blockhash", "left_semi").select(
        transaction.columns
    )
    limited = {"block": block, "transaction": transaction}
    for name, key in schema.TRANSACTION_KEY.items():
        kept = transaction.select(F.col("t_tx_hash").alias(key))
        limited[name] = tables[name].join(kept, key, "left_semi").select(tables[name].columns)
    return limited


def clean_tables(
    staged: dict[str, DataFrame], height_limit: int | None = None
) -> dict[str, DataFrame]:
    """Every staging table pruned and renamed; blocks up to the limit."""
    clean = {name: clean_columns(name, staged[name]) for name in Ledger.names()}
    if height_limit is not None:
        clean["block"] = clean["block"].filter(F.col("b_height") <= height_limit)
    return clean


def normalize(
    staged: dict[str, DataFrame],
    height_limit: int | None = None,
    genesis_tx: str | None = None,
) -> Ledger:
    """Six staging tables to a ledger: prune, limit, resolve inputs, enrich joinsplits."""
    clean = limit_height(clean_tables(staged), height_limit, genesis_tx)
    vin = resolve_inputs(clean["vin"], clean["vout"])
    vjoinsplit = with_joinsplit_addresses(clean["vjoinsplit"], vin, clean["vout"])
    return Ledger(**{**clean, "vin": vin, "vjoinsplit": vjoinsplit})
