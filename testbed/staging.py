"""The derived ledger in the shapes a ledger arrives in: staging tables, dumps, node documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspool import schema
from glasspool.functions.arrays import no_addresses
from glasspool.sources.delimited import DUMP_FILES
from testbed.derive import Testbed, tx_hash, vjoinsplit


def _items(prefix: str, owner: Column, count: Column) -> Column:
    """[`prefix`owner_1, ... `prefix`owner_count]"""
    return F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.concat(F.lit(prefix), owner.cast("string"), F.lit("_"), i.cast("string")),
    )


def joinsplit_arrays(testbed: Testbed) -> DataFrame:
    """(tx_hash, nullifiers, commitments) of every joinsplit."""
    ok = F.col("ok")
    return testbed.retail.orders().filter((ok % 10).between(5, 8)).select(
        tx_hash(ok).alias("tx_hash"),
        _items("n", ok, (1 + ok % 3).cast("int")).alias("nullifiers"),
        _items("c", ok, (1 + ok % 4).cast("int")).alias("commitments"),
    )


def staging_frames(testbed: Testbed) -> dict[str, DataFrame]:
    """Six wide staging tables with money as floating point and true arrays."""
    blank = F.lit("")
    block = testbed.block().select(
        F.col("b_height").alias("height"),
        F.col("b_hash").alias("hash"),
        F.col("b_size").alias("size"),
        F.col("b_version").alias("version"),
        F.lit("root").alias("merkleroot"),
        F.coalesce("b_tx", no_addresses()).alias("tx"),
        F.col("b_time").alias("time"),
        F.lit("nonce").alias("nonce"),
        F.lit(1.5).alias("difficulty"),
        blank.alias("chainwork"),
        blank.alias("anchor"),
        F.col("b_previousblockhash").alias("previousblockhash"),
        F.col("b_nextblockhash").alias("nextblockhash"),
    )
    transaction = testbed.transaction().select(
        F.col("t_tx_hash").alias("tx_hash"),
        F.lit(1).alias("version"),
        F.lit(0).cast("bigint").alias("locktime"),
        F.col("t_blockhash").alias("blockhash"),
        F.col("t_time").alias("time"),
        F.col("t_blocktime").alias("blocktime"),
        F.when(F.col("t_valid"), "t").otherwise("f").alias("valid"),
        F.col("t_tx_vin_count").alias("tx_vin_count"),
        F.col("t_tx_vj_count").alias("tx_vj_count"),
        F.col("t_tx_vout_count").alias("tx_vout_count"),
        F.col("t_type").alias("type"),
    )
    no_id = F.lit(0).cast("bigint").alias("db_id")
    coingen = testbed.ledger().coingen.select(
        no_id,
        F.col("c_tx_hash").alias("tx_hash"),
        F.col("c_coinbase").alias("coinbase"),
        F.col("c_sequence").alias("sequence"),
    )
    vin = testbed.vin().select(
        no_id,
        F.col("vi_tx_hash").alias("tx_hash"),
        F.col("vi_prevout_hash").alias("prevout_hash"),
        F.col("vi_prevout_n").alias("prevout_n"),
        F.lit(4294967295).cast("bigint").alias("sequence"),
        no_addresses().alias("address"),
    )
    vout = testbed.vout().select(
        no_id,
        F.col("vo_tx_hash").alias("tx_hash"),
        F.col("vo_value").cast("double").alias("value"),
        (F.col("vo_value") * 100000000).cast("double").alias("valueZat"),
        F.col("vo_tx_n").alias("tx_n"),
        F.col("vo_pubkey").alias("pubkey"),
        F.lit(False).alias("isVjoinsplit"),
    )
    joinsplit = (
        vjoinsplit(testbed.retail)
        .withColumnRenamed("vj_tx_hash", "tx_hash")
        .join(joinsplit_arrays(testbed), "tx_hash")
        .select(
            no_id,
            "tx_hash",
            F.col("vj_vpub_old").cast("double").alias("vpub_old"),
            F.col("vj_vpub_new").cast("double").alias("vpub_new"),
            blank.alias("anchor"),
            "nullifiers",
            "commitments",
            blank.alias("onetimePubKey"),
            blank.alias("randomSeed"),
            no_addresses().alias("macs"),
            no_addresses().alias("source_address"),
            no_addresses().alias("dest_address"),
        )
    )
    return {
        "block": block,
        "transaction": transaction,
        "coingen": coingen,
        "vin": vin,
        "vout": vout,
        "vjoinsplit": joinsplit,
    }


def dump_frame(staged: DataFrame) -> DataFrame:
    """A staging table as a dump holds it: `{a,b}` arrays, exact decimals, t/f flags."""

    def as_text(name: str, kind) -> Column:
        column = F.col(name)
        if kind == schema.STRINGS:
            return F.concat(F.lit("{"), F.array_join(column, ","), F.lit("}")).alias(name)
        if name in ("value", "valueZat", "vpub_old", "vpub_new"):
            return column.cast(schema.MONEY).alias(name)
        if kind.typeName() == "boolean":
            return F.when(column, "t").otherwise("f").alias(name)
        return column

    return staged.select(*(as_text(field.name, field.dataType) for field in staged.schema.fields))


def write_dumps(testbed: Testbed, folder: str) -> None:
    for name, staged in staging_frames(testbed).items():
        dump_frame(staged).write.option("sep", ";").option("header", "true").csv(
            f"{folder}/{DUMP_FILES[name]}"
        )


def node_blocks(testbed: Testbed) -> DataFrame:
    """Block documents with their listings."""
    return testbed.block().select(
        F.col("b_height").alias("height"),
        F.col("b_hash").alias("hash"),
        F.col("b_size").alias("size"),
        F.col("b_version").alias("version"),
        F.col("b_tx").alias("tx"),
        F.col("b_time").alias("time"),
        F.nullif("b_previousblockhash", F.lit("")).alias("previousblockhash"),
        F.nullif("b_nextblockhash", F.lit("")).alias("nextblockhash"),
    )


def node_transactions(testbed: Testbed) -> DataFrame:
    """One nested document per transaction."""
    none = F.lit(None)
    inputs = testbed.vin().select(
        F.col("vi_tx_hash").alias("txid"),
        F.struct(
            none.cast("string").alias("coinbase"),
            F.lit(4294967295).cast("bigint").alias("sequence"),
            F.col("vi_prevout_hash").alias("txid"),
            F.col("vi_prevout_n").alias("vout"),
        ).alias("entry"),
    )
    coinbases = testbed.ledger().coingen.select(
        F.col("c_tx_hash").alias("txid"),
        F.struct(
            F.col("c_coinbase").alias("coinbase"),
            F.col("c_sequence").alias("sequence"),
            none.cast("string").alias("txid"),
            none.cast("bigint").alias("vout"),
        ).alias("entry"),
    )
    outputs = testbed.vout().select(
        F.col("vo_tx_hash").alias("txid"),
        F.struct("vo_value", "vo_tx_n", "vo_pubkey").alias("entry"),
    )
    joinsplits = vjoinsplit(testbed.retail).select(
        F.col("vj_tx_hash").alias("txid"),
        F.struct(
            F.col("vj_vpub_old").alias("vpub_old"), F.col("vj_vpub_new").alias("vpub_new")
        ).alias("entry"),
    )

    def leg(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("txid").agg(F.collect_list("entry").alias(name))

    def output(entry: Column) -> Column:
        """Built after the rows are gathered, which are narrower."""
        value, addresses = entry["vo_value"], entry["vo_pubkey"]
        return F.struct(
            value.alias("value"),
            (value * 100000000).cast("bigint").alias("valueZat"),
            entry["vo_tx_n"].alias("n"),
            F.struct(F.when(F.size(addresses) > 0, addresses).alias("addresses")).alias("scriptPubKey"),
        )

    return (
        testbed.transaction()
        .select(
            F.col("t_tx_hash").alias("txid"),
            F.lit(1).alias("version"),
            F.lit(0).cast("bigint").alias("locktime"),
            F.col("t_blockhash").alias("blockhash"),
            F.col("t_time").alias("time"),
            F.col("t_blocktime").alias("blocktime"),
        )
        .join(leg(inputs.unionByName(coinbases), "vin"), "txid", "left")
        .join(leg(outputs, "vout"), "txid", "left")
        .join(leg(joinsplits, "vjoinsplit"), "txid", "left")
        .withColumn("vout", F.transform("vout", output))
    )
