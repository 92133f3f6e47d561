"""Folders of transaction and block documents, flattened and appended batch by batch.

Documents of one id are told apart by the stream's state: RocksDB keeps every id an ingest has seen beside
the tasks and logs it in the checkpoint, so a batch looks up its own ids and does not read what the
ingest has stored. The state grows by one id a document and forgets none, so no document comes too late
to be recognised. Only what other ingests have stored is compared by a join; an ingest that is alone in
its store reads nothing.

Input resolution needs every earlier output, so it runs afterwards, over the stored tables
(`resolved_legs`), or as a stream of its own (`streaming.resolve`).
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from glasspool import schema
from glasspool.operators.enrichment import with_joinsplit_addresses
from glasspool.operators.inputs import resolve_inputs
from glasspool.operators.joins import reshuffled
from glasspool.operators.quality import block_listing, missing_transactions
from glasspool.sources.node_json import BROKEN, flatten_blocks, flatten_legs, flatten_transactions, rejected
from glasspool.streaming.state import rocksdb_state
from glasspool.workspace import SMALLER, Workspace

_FIRST = "none"
_UNUSABLE = "_unusable"

_KINDS = {
    "block": schema.BLOCK,
    "transaction": schema.TRANSACTION,
    "coingen": schema.COINGEN,
    "vin": schema.VIN,
    "vout": schema.VOUT,
    "vjoinsplit": schema.VJOINSPLIT,
}


def _folder(path: str, table: str) -> str:
    return f"{path.rstrip('/')}/{table}"


def stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table with the ingest and the number of the batch that wrote each row."""
    marks = [StructField("ingest", StringType()), StructField("batch", LongType())]
    return spark.read.schema(StructType([*_KINDS[table].fields, *marks])).parquet(_folder(path, table))


def _prepare(spark: SparkSession, path: str) -> None:
    """Give every table a first, empty part, so that a store can be read before its first batch."""
    for table, kind in _KINDS.items():
        spark.createDataFrame([], kind).write.mode("overwrite").parquet(
            f"{_folder(path, table)}/ingest={_FIRST}/batch=-1"
        )


def _others(spark: SparkSession, path: str, table: str, key: str, batch: int, ingest: str, known: bool) -> DataFrame:
    """The keys that a batch may repeat, by folder: those of other ingests and, unless the stream's state knows
    them (`known`), those of the other batches of its own."""
    kept = F.col("ingest") != ingest
    if not known:
        kept |= F.col("batch") != batch
    return stored(spark, path, table).filter(kept & (F.col("ingest") != _FIRST)).select(F.col(key).alias("_key"))


def _written(documents: DataFrame, unusable: Column, path: str, kind: StructType, folder: str) -> DataFrame:
    """The documents of one batch, read from where they are stored; documents that cannot be used stop the ingest.

    A batch is computed once: its source is parsed and its state changed by this one write.
    """
    target = f"{path.rstrip('/')}/{folder}"
    documents.withColumn(_UNUSABLE, unusable).drop(BROKEN).write.mode("overwrite").parquet(target, compression=SMALLER)
    whole = StructType([*kind.fields, StructField(_UNUSABLE, BooleanType())])
    found = documents.sparkSession.read.schema(whole).parquet(target)
    if not found.filter(_UNUSABLE).isEmpty():
        raise ValueError("the batch has documents that cannot be used")
    return found.drop(_UNUSABLE)


def _marked(documents: DataFrame) -> DataFrame:
    return documents if BROKEN in documents.columns else documents.withColumn(BROKEN, F.lit(None).cast("string"))


def append_batch(documents: DataFrame, batch: int, path: str, ingest: str = "0", known: bool = False) -> None:
    """Store one batch of an ingest. Repeating a batch replaces what its first attempt wrote.

    Documents of transactions that are stored already, by any ingest and batch but this very one, are
    dropped by one anti-join on the transaction hash; all legs follow their document. With `known` the
    batch repeats nothing of its own ingest, and only other ingests are read. The unseen documents are
    written first, so the legs of a repeated task come from the same rows. Documents that cannot be
    used stop the ingest.
    """
    spark, documents = documents.sparkSession, _marked(documents)
    part = f"ingest={ingest}/batch={batch}"
    nested = _written(documents, rejected(), path, schema.NODE_TRANSACTION, f"_documents/{part}")
    others = _others(spark, path, "transaction", "t_tx_hash", batch, ingest, known)
    if known and others.isEmpty():
        unseen = nested
    else:
        # stored before it is flattened, so that all legs come from the same rows
        target = f"{path.rstrip('/')}/_unseen/{part}"
        nested.dropDuplicates(["txid"]).join(
            reshuffled(others, "_key"), F.col("txid") == F.col("_key"), "left_anti"
        ).write.mode("overwrite").parquet(target, compression=SMALLER)
        unseen = spark.read.schema(schema.NODE_TRANSACTION).parquet(target)
    # the transactions come last: they are what later batches are compared with
    for table, rows in {**flatten_legs(unseen), "transaction": flatten_transactions(unseen)}.items():
        rows.write.mode("overwrite").parquet(f"{_folder(path, table)}/{part}", compression=SMALLER)


def _ingest_id(checkpoint: str) -> str:
    """An ingest is known by the place of its checkpoint."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def append_blocks(documents: DataFrame, batch: int, path: str, ingest: str = "0", known: bool = False) -> None:
    """Store the blocks of one batch that no other batch has stored, as `append_batch` does transactions."""
    spark, documents = documents.sparkSession, _marked(documents)
    part = f"ingest={ingest}/batch={batch}"
    nested = _written(documents, _unusable_block(), path, schema.NODE_BLOCK, f"_blocks/{part}")
    others = _others(spark, path, "block", "b_hash", batch, ingest, known)
    unseen = nested.dropDuplicates(["hash"]).join(reshuffled(others, "_key"), F.col("hash") == F.col("_key"), "left_anti")
    flatten_blocks(unseen).write.mode("overwrite").parquet(
        f"{_folder(path, 'block')}/{part}", compression=SMALLER
    )


def _unusable_block() -> Column:
    return F.col("hash").isNull() | F.col("height").isNull() | F.col(BROKEN).isNotNull()


def start_ingest(
    spark: SparkSession,
    source: str,
    path: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append every transaction document not yet read from `source`, then stop; restart to continue.

    `files_per_batch` splits a backlog into batches of bounded size. Several ingests may fill one
    store, each with its own checkpoint. A checkpoint that was lost while its batches are stored is
    refused: its batch numbers would start again and replace them. The number of shuffle partitions of
    the first run stays that of the state.
    """
    return _start(spark, source, path, checkpoint, files_per_batch, "transaction", schema.NODE_TRANSACTION, "txid", rejected(), append_batch)


def start_block_ingest(
    spark: SparkSession,
    source: str,
    path: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append every block document not yet read from `source` to the same store, as `start_ingest`."""
    return _start(spark, source, path, checkpoint, files_per_batch, "block", schema.NODE_BLOCK, "hash", _unusable_block(), append_blocks)


def narrowed(documents: DataFrame) -> DataFrame:
    """Transaction documents without the fields of outputs and joinsplits that nothing stores: they need not be shuffled."""
    if "vout" not in documents.columns:
        return documents
    dropped = [field.name for field in documents.schema["vjoinsplit"].dataType.elementType.fields]
    dropped = [name for name in dropped if name not in ("vpub_old", "vpub_new")]
    return documents.withColumns(
        {
            "vout": F.transform("vout", lambda entry: entry.dropFields("valueZat")),
            "vjoinsplit": F.transform("vjoinsplit", lambda entry: entry.dropFields(*dropped)) if dropped else F.col("vjoinsplit"),
        }
    )


def _start(spark, source, path, checkpoint, files_per_batch, table, kind, key, unusable, append) -> StreamingQuery:
    if not _exists(spark, path):
        _prepare(spark, path)
    ingest = _ingest_id(checkpoint)
    known = not stored(spark, path, table).filter(F.col("ingest") == ingest).isEmpty()
    if known and not _has_files(spark, checkpoint):
        raise ValueError(f"{checkpoint} is empty, but its batches are stored; use another checkpoint")
    whole = StructType([*kind.fields, StructField(BROKEN, StringType())])
    reader = spark.readStream.schema(whole).option("columnNameOfCorruptRecord", BROKEN)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a usable document is never hidden by one that is not
    found = narrowed(reader.json(source).withColumn(_UNUSABLE, unusable))
    fresh = found.dropDuplicates([key, _UNUSABLE]).drop(_UNUSABLE)
    with rocksdb_state(spark):
        return (
            fresh.writeStream.foreachBatch(lambda rows, batch: append(rows, batch, path, ingest, known=True))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def _has_files(spark: SparkSession, folder: str) -> bool:
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").isEmpty()
    except AnalysisException:
        return False


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        stored(spark, path, "transaction")
    except AnalysisException:
        return False
    return True


def resolved_legs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stored tables with inputs resolved and joinsplits enriched, and with an invalid row for each
    transaction that a block names but no document describes."""
    tables = {name: stored(spark, path, name).drop("ingest", "batch") for name in _KINDS}
    # written, because both the inputs and the address sets read it
    vin = Workspace.of(spark).store(resolve_inputs(tables["vin"], tables["vout"]), compression=SMALLER)
    vjoinsplit = with_joinsplit_addresses(tables["vjoinsplit"], vin, tables["vout"])
    absent = missing_transactions(block_listing(tables["block"]), tables["transaction"])
    transaction = tables["transaction"].unionByName(absent)
    return {**tables, "transaction": transaction, "vin": vin, "vjoinsplit": vjoinsplit}
