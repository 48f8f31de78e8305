"""Structured Streaming forms of ingestion, capture and per-file state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.briefs import pending_step
from ..operators.ingest import chunk_rows
from ..sources.commits import Change, Store
from ..sources.files import write_records
from .folds import fold_stream


#: Parts of a store's table beyond which a batch folds them together.
MOST_PARTS = 50
BATCHES = "source string, batch long"


def ingest_stream(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, key: str = "doc_id", order: list[str] | None = None) -> StreamingQuery:
    """Parquet files as they come: each micro-batch is one commit of its rows, in place of those of their keys, and of its number.

    A batch that is run again after a failure finds its number and changes nothing, so the store is right at any time.
    Of several rows of a key in a batch the last by ``order`` counts, or the greatest by all columns.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        _take(batch, batch_id, store, key, order, checkpoint)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _take(batch: DataFrame, batch_id: int, store: str, key: str, order: list[str] | None, source: str) -> None:
    spark, place = batch.sparkSession, Store(batch.sparkSession, store)
    rest = [c for c in batch.columns if c not in (key, *(order or []))]
    last = batch.groupBy(key).agg(F.max(F.struct(*(order or []), *rest)).alias("row_"))
    rows = last.select(*(F.col(c) if c == key else F.col(f"row_.{c}").alias(c) for c in batch.columns))

    def apply(change: Change) -> None:
        if change.read("batches", BATCHES).where((F.col("source") == source) & (F.col("batch") >= batch_id)).isEmpty():
            change.upsert("rows", rows, key)
            change.upsert("batches", spark.createDataFrame([(source, batch_id)], BATCHES), "source")

    place.change(apply)
    if len(place.head()[1].get("rows", {"parts": []})["parts"]) > MOST_PARTS:
        compact(spark, store)


def capture(spark: SparkSession, source: str, schema: str, log: str, store: str, checkpoint: str, key: str = "record_id", order: list[str] | None = None) -> StreamingQuery:
    """Records as they come: each micro-batch becomes a part of the record log, named after it, then a commit of the store."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_records(batch, f"{log}/{batch_id:012d}")
        _take(batch, batch_id, store, key, order, checkpoint)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """The last row of each key."""
    return Store(spark, store).read("rows", schema=schema)


def compact(spark: SparkSession, store: str, keep: int = 10) -> None:
    """Fold the store's parts together, and remove those that the last commits don't need."""
    place = Store(spark, store)
    for table in place.tables():
        place.compact(table)
    place.vacuum(keep)


def chunk_stream(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of a stream of documents: a map, so no state."""
    return chunk_rows(docs, keys)


def dedup_stream(records: DataFrame, time: str, delay: str, key: str = "record_id") -> DataFrame:
    """Records that come again within the delay are dropped; state older than it goes."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def pending_topics(records: DataFrame, delay: str, idle: int | None = None, least: float = 0.25) -> DataFrame:
    """Per file, in order of time, whether a record passes and what stays pending.

    records: file_id, record_id, ordinal, at, brief_score. A record under ``least`` is pending; one after
    a pending record shifts the topic if it resembles that one as much (score within ``least`` of it).
    Records may come late and over several batches; a file's state goes once it had no record for ``idle`` milliseconds.
    """
    kind = records.schema["file_id"].dataType.simpleString()
    return fold_stream(records, "file_id", "at", ["ordinal", "record_id"], pending_step(least), f"file_id {kind}, record_id string, route string, pending string", delay, idle)


def event_windows(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums per window and type; late rows beyond the delay are dropped by the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
