"""Nested block and transaction documents, flattened to the clean tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from glasspool import schema
from glasspool.functions.arrays import distinct_sorted, no_addresses
from glasspool.functions.classify import raw_destination, transaction_type
from glasspool.functions.money import to_money
from glasspool.ledger import Ledger
from glasspool.operators.enrichment import with_joinsplit_addresses
from glasspool.operators.inputs import resolve_inputs
from glasspool.operators.quality import block_listing, missing_transactions
from glasspool.sources.snapshot import load_ledger, save_clean
from glasspool.workspace import SMALLER, Workspace


BROKEN = "broken"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Block documents; reading stops at one that is not valid."""
    return spark.read.schema(schema.NODE_BLOCK).option("mode", "FAILFAST").json(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transaction documents; reading stops at one that is not valid."""
    return spark.read.schema(schema.NODE_TRANSACTION).option("mode", "FAILFAST").json(path)


def read_any_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transaction documents with the text of those that are not valid in column `broken`."""
    kind = StructType([*schema.NODE_TRANSACTION.fields, StructField(BROKEN, StringType())])
    return (
        spark.read.schema(kind)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN)
        .json(path)
    )


def _lacks(leg: str, *fields: str) -> Column:
    """Does an entry of the leg lack one of the fields?"""

    def lacking(entry: Column) -> Column:
        return reduce(Column.__or__, [entry[field].isNull() for field in fields])

    return F.coalesce(F.exists(leg, lacking), F.lit(False))


def rejected() -> Column:
    """Documents that cannot be used: not valid JSON of the expected types, no id, or a leg without
    its number, amount or source."""
    coinbase_or_source = F.coalesce(
        F.exists("vin", lambda e: e["coinbase"].isNull() & (e["txid"].isNull() | e["vout"].isNull())),
        F.lit(False),
    )
    return (
        F.col(BROKEN).isNotNull()
        | F.col("txid").isNull()
        | coinbase_or_source
        | _lacks("vout", "value", "n")
        | _lacks("vjoinsplit", "vpub_old", "vpub_new")
    )


def flatten_blocks(blocks: DataFrame) -> DataFrame:
    blank = F.lit("")
    return blocks.select(
        F.col("height").alias("b_height"),
        F.col("hash").alias("b_hash"),
        F.col("size").alias("b_size"),
        F.col("version").alias("b_version"),
        F.col("tx").alias("b_tx"),
        F.col("time").alias("b_time"),
        F.coalesce("previousblockhash", blank).alias("b_previousblockhash"),
        F.coalesce("nextblockhash", blank).alias("b_nextblockhash"),
    )


def _leg_size(leg: str) -> Column:
    return F.coalesce(F.size(leg), F.lit(0))


def output_addresses(output: Column) -> Column:
    addresses = output["scriptPubKey"]["addresses"]
    return F.coalesce(distinct_sorted(addresses), no_addresses())


def flatten_transactions(documents: DataFrame) -> DataFrame:
    """Clean transaction rows with leg counts and type."""
    inputs, outputs, joinsplits = _leg_size("vin"), _leg_size("vout"), _leg_size("vjoinsplit")
    coinbases = F.coalesce(
        F.size(F.filter("vin", lambda entry: entry["coinbase"].isNotNull())), F.lit(0)
    )
    return documents.select(
        F.col("txid").alias("t_tx_hash"),
        F.col("blockhash").alias("t_blockhash"),
        F.col("time").alias("t_time"),
        F.col("blocktime").alias("t_blocktime"),
        F.lit(True).alias("t_valid"),
        inputs.alias("t_tx_vin_count"),
        joinsplits.alias("t_tx_vj_count"),
        outputs.alias("t_tx_vout_count"),
        transaction_type(inputs, outputs, joinsplits, coinbases).alias("t_type"),
    )


def flatten_legs(documents: DataFrame) -> dict[str, DataFrame]:
    """coingen, vin (not resolved), vout, and vjoinsplit with the addresses known so far."""
    entries = documents.select("txid", F.explode("vin").alias("entry"))
    coinbase = F.col("entry.coinbase")
    outputs = documents.select("txid", F.explode("vout").alias("entry"))
    every_output_address = distinct_sorted(
        F.flatten(F.transform(F.coalesce("vout", F.array()), output_addresses))
    )
    return {
        "coingen": entries.filter(coinbase.isNotNull()).select(
            F.col("txid").alias("c_tx_hash"),
            coinbase.alias("c_coinbase"),
            F.col("entry.sequence").alias("c_sequence"),
        ),
        "vin": entries.filter(coinbase.isNull()).select(
            F.col("txid").alias("vi_tx_hash"),
            F.col("entry.txid").alias("vi_prevout_hash"),
            F.col("entry.vout").alias("vi_prevout_n"),
        ),
        "vout": outputs.select(
            F.col("txid").alias("vo_tx_hash"),
            to_money(F.col("entry.value")).alias("vo_value"),
            F.col("entry.n").alias("vo_tx_n"),
            output_addresses(F.col("entry")).alias("vo_pubkey"),
        ),
        "vjoinsplit": documents.select(
            "txid",
            _leg_size("vin").alias("_inputs"),
            _leg_size("vout").alias("_outputs"),
            every_output_address.alias("_addresses"),
            "vjoinsplit",
        )
        .select(
            "txid", "_inputs", "_outputs", "_addresses", F.explode("vjoinsplit").alias("entry")
        )
        .select(
            F.col("txid").alias("vj_tx_hash"),
            to_money(F.col("entry.vpub_old")).alias("vj_vpub_old"),
            to_money(F.col("entry.vpub_new")).alias("vj_vpub_new"),
            no_addresses().alias("vj_source_address"),
            raw_destination(
                F.col("_inputs"), F.col("_outputs"), F.col("entry.vpub_new"), F.col("_addresses")
            ).alias("vj_dest_address"),
        ),
    }


def flatten(blocks: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """The clean tables before input resolution.

    A transaction that a block names but no document describes is kept as an invalid row.
    """
    block = flatten_blocks(blocks)
    known = flatten_transactions(documents)
    transaction = known.unionByName(missing_transactions(block_listing(block), known))
    return {"block": block, "transaction": transaction, **flatten_legs(documents)}


def load_documents(spark: SparkSession, blocks_path: str, transactions_path: str) -> Ledger:
    """Documents to a ledger: flatten, resolve inputs, enrich joinsplits."""
    clean = flatten(
        read_blocks(spark, blocks_path), read_transactions(spark, transactions_path)
    )
    vin = resolve_inputs(clean["vin"], clean["vout"])
    vjoinsplit = with_joinsplit_addresses(clean["vjoinsplit"], vin, clean["vout"])
    return Ledger(**{**clean, "vin": vin, "vjoinsplit": vjoinsplit})


def import_documents(
    spark: SparkSession,
    blocks_path: str,
    transactions_path: str,
    path: str,
    workspace: Workspace,
    rejects_path: str | None = None,
) -> Ledger:
    """Documents to a stored ledger.

    The text is parsed once, into nested Parquet; each leg then reads only its own columns. Documents
    that cannot be used are an error, or are written to `rejects_path` and left out.
    """
    documents = workspace.store(read_any_transactions(spark, transactions_path), compression=SMALLER)
    bad = documents.filter(rejected())
    if rejects_path is not None:
        bad.write.mode("overwrite").parquet(rejects_path, compression=SMALLER)
    elif not bad.isEmpty():
        raise ValueError(f"{transactions_path}: {bad.count()} documents cannot be used")
    good = documents.filter(~rejected()).drop(BROKEN)
    save_clean(spark, flatten(read_blocks(spark, blocks_path), good), path)
    return load_ledger(spark, path)
