"""Declared schemas: the clean tables, the wide staging dumps, and the nested node documents."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

MONEY = DecimalType(32, 8)
MONEY_TOTAL = DecimalType(38, 8)
STRINGS = ArrayType(StringType())

_TYPES: dict[str, DataType] = {
    "string": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "boolean": BooleanType(),
    "double": DoubleType(),
    "money": MONEY,
    "strings": STRINGS,
}


def _table(columns: str) -> StructType:
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


# Clean tables -------------------------------------------------------------------------------

TRANSACTION = _table(
    "t_tx_hash string, t_blockhash string, t_time int, t_blocktime int, t_valid boolean,"
    "t_tx_vin_count int, t_tx_vj_count int, t_tx_vout_count int, t_type string"
)
BLOCK = _table(
    "b_height bigint, b_hash string, b_size int, b_version int, b_tx strings, b_time int,"
    "b_previousblockhash string, b_nextblockhash string"
)
COINGEN = _table("c_tx_hash string, c_coinbase string, c_sequence bigint")
VIN = _table("vi_tx_hash string, vi_prevout_hash string, vi_prevout_n bigint")
VIN_RESOLVED = _table(
    "vi_tx_hash string, vi_prevout_hash string, vi_prevout_n bigint,"
    "vi_address strings, vi_value money"
)
VOUT = _table("vo_tx_hash string, vo_value money, vo_tx_n bigint, vo_pubkey strings")
VJOINSPLIT = _table(
    "vj_tx_hash string, vj_vpub_old money, vj_vpub_new money,"
    "vj_source_address strings, vj_dest_address strings"
)

CLEAN: dict[str, StructType] = {
    "transaction": TRANSACTION,
    "block": BLOCK,
    "coingen": COINGEN,
    "vin": VIN_RESOLVED,
    "vout": VOUT,
    "vjoinsplit": VJOINSPLIT,
}

# Natural keys. Joinsplits have none: a transaction may hold several equal ones.
KEYS: dict[str, list[str]] = {
    "transaction": ["t_tx_hash"],
    "block": ["b_height"],
    "coingen": ["c_tx_hash"],
    "vin": ["vi_tx_hash", "vi_prevout_hash", "vi_prevout_n"],
    "vout": ["vo_tx_hash", "vo_tx_n"],
}

# The column by which each child table names its transaction.
TRANSACTION_KEY: dict[str, str] = {
    "coingen": "c_tx_hash",
    "vin": "vi_tx_hash",
    "vout": "vo_tx_hash",
    "vjoinsplit": "vj_tx_hash",
}

# Staging tables -----------------------------------------------------------------------------
# Column order is the order of the delimited dumps. Array columns are text there and true arrays
# in a relational store; `staging_schema` gives either form.

_STAGING: dict[str, str] = {
    "transaction": (
        "tx_hash string, version int, locktime bigint, blockhash string, time int, blocktime int,"
        "valid string, tx_vin_count int, tx_vj_count int, tx_vout_count int, type string"
    ),
    "block": (
        "height bigint, hash string, size int, version int, merkleroot string, tx strings,"
        "time int, nonce string, difficulty double, chainwork string, anchor string,"
        "previousblockhash string, nextblockhash string"
    ),
    "coingen": "db_id bigint, tx_hash string, coinbase string, sequence bigint",
    "vin": (
        "db_id bigint, tx_hash string, prevout_hash string, prevout_n bigint, sequence bigint,"
        "address strings"
    ),
    "vout": (
        "db_id bigint, tx_hash string, value double, valueZat double, tx_n bigint, pubkey strings,"
        "isVjoinsplit boolean"
    ),
    "vjoinsplit": (
        "db_id bigint, tx_hash string, vpub_old double, vpub_new double, anchor string,"
        "nullifiers strings, commitments strings, onetimePubKey string, randomSeed string,"
        "macs strings, source_address strings, dest_address strings"
    ),
}

STAGING: dict[str, StructType] = {name: _table(columns) for name, columns in _STAGING.items()}


def dump_schema(table: str) -> StructType:
    """Schema of one delimited dump: arrays, flags and money are still text-shaped."""
    as_text = {"strings": "string", "boolean": "string", "double": "money"}
    fields = []
    for column in _STAGING[table].split(","):
        name, kind = column.split()
        # difficulty is the one fractional column that is not money
        kind = "double" if name == "difficulty" else as_text.get(kind, kind)
        fields.append(StructField(name, _TYPES[kind]))
    return StructType(fields)


# Node documents -----------------------------------------------------------------------------

NODE_BLOCK = _table(
    "height bigint, hash string, size int, version int, merkleroot string, tx strings, time int,"
    "nonce string, difficulty double, chainwork string, anchor string,"
    "previousblockhash string, nextblockhash string"
)

NODE_TRANSACTION = StructType(
    [
        *_table("txid string, version int, locktime bigint, blockhash string, time int, blocktime int"),
        StructField(
            "vin",
            ArrayType(_table("coinbase string, sequence bigint, txid string, vout bigint")),
        ),
        StructField(
            "vout",
            ArrayType(
                StructType(
                    [
                        *_table("value money, valueZat bigint, n bigint"),
                        StructField("scriptPubKey", _table("addresses strings")),
                    ]
                )
            ),
        ),
        StructField(
            "vjoinsplit",
            ArrayType(
                _table(
                    "vpub_old money, vpub_new money, anchor string, nullifiers strings,"
                    "commitments strings, onetimePubKey string, randomSeed string, macs strings"
                )
            ),
        ),
    ]
)

ADDRESS_LIST = _table("address string")
ADDRESS_TAGS = _table("address string, tag string")
