"""Input resolution as documents arrive: a keyed state of unspent outputs and waiting inputs.

Every output and input of a document is sent to the transaction that made the output. Its state holds the
outputs no input has spent yet and the inputs whose output has not arrived. Where both are there the
input is resolved, written out, and both leave the state; so a late output releases the inputs that wait
for it, and spent outputs are forgotten. The state is kept by RocksDB beside the tasks and logged
in the checkpoint: a batch reads and writes the transactions it names, however much is stored.

Transactions are dealt into buckets by hash, and Python runs once per bucket and batch: a group's fixed cost
is some milliseconds, a transaction's two calls to the state a fraction of that. The legs that one batch has
for one bucket are held in memory; `files_per_batch` bounds a batch, `buckets` their number.

A transaction's state is bounded by the outputs it can have. What grows is the number of entries:
transactions with unspent outputs, and missing ones that an input names.

Defined results: an output is spent by the first input that names it, in the order of batches and then of
spending transactions; a later one waits for good, as an input of an unknown transaction does; documents
of one id that come again in one ingest must be dropped before (`distinct_documents`); coinbases are no inputs;
documents that cannot be used stop the stream.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from glasspool import schema
from glasspool.functions.money import to_money
from glasspool.sources.node_json import BROKEN, output_addresses, rejected
from glasspool.streaming.state import rocksdb_state

# workers get the processor by value and need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: JSON texts, null for none: {n, addresses, value} of unspent outputs, [n, spender] of waiting inputs. Plain columns
#: cross to the state store and back much faster than nested ones; amounts are text in them, which is exact
_STATE = "unspent string, waiting string"
_OUTPUTS = "array<struct<n: bigint, addresses: array<string>, value: string>>"
_LEGS = "array<struct<source: string, outputs: string, n: bigint, spender: string>>"
_RESOLVED = "vi_tx_hash string, vi_prevout_hash string, vi_prevout_n bigint, vi_address array<string>, value string"
#: a stream keeps the number it was started with, as its state is stored by bucket
BUCKETS = 4096


def outputs_and_inputs(documents: DataFrame) -> DataFrame:
    """(source, outputs, n, spender): all outputs of a document as one JSON text, or an input."""
    nothing = F.lit(None)
    made = F.transform(
        F.coalesce("vout", F.array()),
        lambda o: F.struct(
            o["n"].alias("n"), output_addresses(o).alias("addresses"), to_money(o["value"]).cast("string").alias("value")
        ),
    )
    outputs = F.struct(
        F.col("txid").alias("source"), F.to_json(made.cast(_OUTPUTS), {"ignoreNullFields": "false"}).alias("outputs"),
        F.lit(0).cast("bigint").alias("n"), nothing.cast("string").alias("spender"),
    )
    inputs = F.transform(
        F.filter(F.coalesce("vin", F.array()), lambda i: i["coinbase"].isNull()),
        lambda i: F.struct(
            i["txid"].alias("source"), nothing.cast("string").alias("outputs"),
            i["vout"].alias("n"), F.col("txid").alias("spender"),
        ),
    )
    any_made = F.when(F.size(made) > 0, F.array(outputs)).otherwise(F.array())
    return documents.select(F.explode(F.concat(any_made.cast(_LEGS), inputs.cast(_LEGS))).alias("leg")).select("leg.*")


class Resolver(StatefulProcessor):
    """The outputs of the transactions of one bucket, and who spends them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getMapState("held", "source string", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        legs: dict[str, tuple[list, list]] = {}
        for part in rows:
            for source, outputs, n, spender in zip(part["source"], part["outputs"], part["n"], part["spender"]):
                made, spending = legs.setdefault(source, ([], []))
                if spender is None:
                    made.append(outputs)
                else:
                    spending.append([int(n), spender])
        any_held, resolved = self._held.exists(), []
        for source, (made, spending) in legs.items():
            resolved += self._settled(source, made, spending, any_held)
        names = ["vi_tx_hash", "vi_prevout_hash", "vi_prevout_n", "vi_address", "value"]
        if resolved:
            yield pd.DataFrame(resolved, columns=names)

    def _settled(self, source: str, made: list[str], spending: list, any_held: bool) -> list[tuple]:
        """The inputs that the batch's legs of one transaction, and what is held of it, resolve; keeps the rest."""
        held = self._held.getValue((source,)) if any_held else None
        if held is None and len(made) == 1 and not spending:
            self._held.updateValue((source,), (made[0], None))
            return []
        outputs, inputs = held or (None, None)
        unspent = {o["n"]: o for text in [outputs, *made] if text for o in json.loads(text)}
        waiting = (json.loads(inputs) if inputs else []) + spending
        waiting.sort(key=lambda w: (w[1], w[0]))
        found, left = [], []
        for n, spender in waiting:
            if n in unspent:
                output = unspent.pop(n)
                found.append((spender, source, n, output["addresses"], output["value"]))
            else:
                left.append([n, spender])
        if unspent or left:
            kept = [json.dumps(side) if side else None for side in (list(unspent.values()), left)]
            self._held.updateValue((source,), tuple(kept))
        elif held is not None:
            self._held.removeKey((source,))
        return found

    def close(self) -> None:
        pass


def resolved_stream(documents: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Resolved inputs of a stream of transaction documents."""
    bucket = F.pmod(F.xxhash64("source"), F.lit(buckets)).alias("bucket")
    resolved = outputs_and_inputs(documents).select(bucket, "*").groupBy("bucket").transformWithStateInPandas(
        Resolver(), outputStructType=StructType.fromDDL(_RESOLVED), outputMode="Append", timeMode="None"
    )
    return resolved.withColumn("vi_value", F.col("value").cast(schema.MONEY)).select(schema.VIN_RESOLVED.names)


def distinct_documents(documents: DataFrame) -> DataFrame:
    """Of documents with one id the first to come; the state has one entry per id."""
    return documents.dropDuplicates(["txid"])


def start_resolving(
    spark: SparkSession,
    source: str,
    path: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    distinct: bool = True,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append the inputs resolved by the documents not yet read from `source` to `path`, then stop.

    A restart goes on with the state of the checkpoint; files are written once whatever is repeated.
    With `distinct` False the source must not hold a document twice. A checkpoint goes on with the number of
    buckets it was started with; one written before there were buckets cannot be continued.
    """
    whole = StructType([*schema.NODE_TRANSACTION.fields, StructField(BROKEN, StringType())])
    reader = spark.readStream.schema(whole).option("columnNameOfCorruptRecord", BROKEN)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    read = reader.json(source)
    usable = F.when(rejected(), F.raise_error(F.lit("a document cannot be used"))).otherwise(F.lit(True))
    documents = read.filter(usable.cast("boolean")).drop(BROKEN)
    with rocksdb_state(spark):
        return (
            resolved_stream(distinct_documents(documents) if distinct else documents, buckets)
            .writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(path)
        )


def resolved_inputs(spark: SparkSession, path: str) -> DataFrame:
    """What has been resolved so far."""
    return spark.read.schema(schema.VIN_RESOLVED).parquet(path)
