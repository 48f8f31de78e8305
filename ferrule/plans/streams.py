"""Streams run to their end: each gives what a batch over the same files gives."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import briefs

from ..sources.commits import Files
from ..sources.files import read_records
from ..sources.shared import shared_dir
from ..streaming import ingest as streaming
from .ingest import CHUNKS
from .memory import RECS, recs
from .registry import query, table
from .texts import LEAST, TOP_MEAN, _vectors


def shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream writes for the files that are there, from a Parquet sink in the shared folder."""
    root, spark = shared(stream.sparkSession), stream.sparkSession
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/check").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def stream_ingest_batch(spark, sf_dir):
    """Documents arrive as files; each micro-batch adds a delta to the store."""
    root = shared(spark)
    source = f"{sf_dir}/documents.parquet"
    docs = spark.read.parquet(source).select("doc_id", "text")
    streaming.ingest_stream(spark, f"{sf_dir}/documents.parque[t]", _ddl(docs), f"{root}/store", f"{root}/check").awaitTermination()
    return streaming.stored(spark, f"{root}/store", _ddl(docs)).select("doc_id", F.sha2("text", 256).alias("sha"))


CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
BUCKET = "time_bucket(INTERVAL 5 MINUTE, CAST(ts AS TIMESTAMP))"


@query(f"SELECT start, event_type, n, total FROM (SELECT {BUCKET} AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2) WHERE start + INTERVAL 5 MINUTE <= {CLOSED}")
def stream_event_windows(spark, sf_dir):
    """Closed windows only: the watermark holds back those that late events may still join."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    out = run_to_end(streaming.event_windows(stream.withColumn("ts", F.col("ts").cast("timestamp"))))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


STEP = """CASE WHEN x.score >= 0.25 THEN {'id': x.id, 'score': 0::DOUBLE, 'pending': '', 'out': list_concat(a.out, [x.id || '|activebrief_update|'])}
WHEN a.pending <> '' AND abs(x.score - a.score) <= 0.25 THEN {'id': x.id, 'score': 0::DOUBLE, 'pending': '', 'out': list_concat(a.out, [x.id || '|pending_topic_shift|'])}
ELSE {'id': x.id, 'score': x.score, 'pending': x.id, 'out': list_concat(a.out, [x.id || '|skip_and_update_pending_topic|' || x.id])} END"""


@query(f"""SELECT file_id, split_part(o, '|', 1) AS record_id, split_part(o, '|', 2) AS route, split_part(o, '|', 3) AS pending FROM (
SELECT file_id, unnest(list_reduce(list_concat([{{'id': '', 'score': 0::DOUBLE, 'pending': '', 'out': []::VARCHAR[]}}], rows), lambda a, x: {STEP}).out) AS o FROM (
SELECT conv_id AS file_id, list({{'id': conv_id || '-' || turn, 'score': (length(text) % 100) / 100.0::DOUBLE, 'pending': '', 'out': []::VARCHAR[]}} ORDER BY turn) AS rows FROM conversations WHERE role = 'user' GROUP BY 1))""")
def stream_pending_topics(spark, sf_dir):
    """Per-conversation state over turns that come out of order and over several batches; in SQL, a fold over each conversation's turns in order."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    rows = turns.select(F.col("conv_id").alias("file_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"), F.col("turn").alias("ordinal"), at_turn(F.col("turn")).alias("at"), ((F.length("text") % 100) / 100.0).alias("brief_score"))
    stream = in_batches(rows, 3, F.col("ordinal"))
    return run_to_end(streaming.pending_topics(stream, "30 days")).where("file_id IS NOT NULL")


def at_turn(turn: Column) -> Column:
    """Turns are a minute apart."""
    return F.timestamp_seconds(F.lit(1_700_000_000) + 60 * turn)


def in_batches(rows: DataFrame, n: int, by: Column) -> DataFrame:
    """A stream of rows in n batches, dealt by a number, so that each batch holds rows before and after those of others; and a last row, of no file and much later.

    A batch has as many files as the cluster has cores, so that all of them write and read it.
    """
    spark, root = rows.sparkSession, shared(rows.sparkSession)
    files = max(1, spark.sparkContext.defaultParallelism)
    parts = [rows.where(F.pmod(by, F.lit(n)) == n - 1 - i).repartition(files) for i in range(n)]
    late = {"at": F.timestamp_seconds(F.lit(4_000_000_000))}
    end = spark.range(1).select(*(late.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema))
    for i, part in enumerate([*parts, end.coalesce(1)]):
        part.write.parquet(f"{root}/in/{i}")
    most = max(sum(name.startswith("part-") for name in Files(spark, root).names(f"in/{i}")) for i in range(n))
    # one folder each: files are taken in order of their time of change
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", most).parquet(f"{root}/in/*")


BRIEF_COLUMNS = ("record_id", "route", "contributors", "n_vectors", "pending_id")
OWN = f"list_concat({_vectors('input_text')}, {_vectors('output_text')})"
SUM = lambda a, b: f"list_transform(range(1, 65), lambda d: coalesce({a}[d], 0) + coalesce({b}[d], 0))"
LIKE = "list_transform(own, lambda x: coalesce(list_sum(list_transform(range(1, 65), lambda d: x[d] * {c}[d])) / nullif(sqrt(list_sum(list_transform(range(1, 65), lambda d: x[d] * x[d]))) * sqrt(list_sum(list_transform(range(1, 65), lambda d: {c}[d] * {c}[d]))), 0), 0))"
MEAN = lambda c: TOP_MEAN.format(s=LIKE.format(c=c))
RUNNING = f"""WITH RECURSIVE s AS (SELECT file_id, record_id, tag, row_number() OVER (PARTITION BY file_id ORDER BY ordinal, record_id) AS i, own, len(own) AS n,
list_transform(range(1, 65), lambda d: coalesce(list_sum(list_transform(own, lambda x: x[d])), 0)) AS t FROM (SELECT *, {OWN} AS own FROM {RECS})),
f AS (SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS i, '' AS record_id, '' AS route, NULL::DOUBLE[] AS bt, CAST(0 AS BIGINT) AS bn, []::VARCHAR[] AS ids, NULL::DOUBLE[] AS pt, CAST(0 AS BIGINT) AS pn, '' AS pid, false AS pblack, []::VARCHAR[] AS out_ids, CAST(0 AS BIGINT) AS out_n FROM s
UNION ALL SELECT file_id, i, record_id, route, CASE WHEN black OR out_n = 0 THEN bt ELSE out_t END, CASE WHEN black OR out_n = 0 THEN bn ELSE out_n END, CASE WHEN black OR out_n = 0 THEN ids ELSE out_ids END,
CASE WHEN moved THEN NULL ELSE t END, CASE WHEN moved THEN 0 ELSE n END, CASE WHEN moved THEN '' ELSE record_id END, NOT moved AND tag = 'Black', out_ids, out_n FROM (
SELECT *, moved AND (tag = 'Black' OR route = 'pending_topic_shift' AND pblack) AS black, CASE WHEN NOT moved THEN bt WHEN route = 'pending_topic_shift' THEN {SUM(SUM('bt', 'pt'), 't')} ELSE {SUM('bt', 't')} END AS out_t,
CASE WHEN NOT moved THEN bn WHEN route = 'pending_topic_shift' THEN bn + pn + n ELSE bn + n END AS out_n, CASE WHEN NOT moved THEN ids WHEN route = 'pending_topic_shift' THEN list_concat(ids, [pid, record_id]) ELSE list_concat(ids, [record_id]) END AS out_ids FROM (
SELECT *, route IN ('init_no_previous_activebrief', 'activebrief_update', 'pending_topic_shift') AS moved FROM (
SELECT s.*, f.bt, f.bn, f.ids, f.pt, f.pn, f.pid, f.pblack, CASE WHEN f.bn = 0 THEN 'init_no_previous_activebrief' WHEN n = 0 THEN 'skip_no_qa_vectors' WHEN {MEAN('f.bt')} >= {LEAST} THEN 'activebrief_update'
WHEN f.pn > 0 AND {MEAN('f.pt')} >= {LEAST} THEN 'pending_topic_shift' ELSE 'skip_and_update_pending_topic' END AS route FROM f JOIN s ON s.file_id = f.file_id AND s.i = f.i + 1))))
SELECT record_id, route, out_ids AS contributors, out_n AS n_vectors, pid AS pending_id FROM f WHERE i > 0"""


def timed(spark, sf_dir) -> DataFrame:
    return recs(spark, sf_dir).withColumn("at", at_turn(F.col("ordinal")))


@query(RUNNING)
def running_brief(spark, sf_dir):
    """Route of every record, and what its brief comes from: a fold over each conversation's records."""
    return briefs.running_briefs(timed(spark, sf_dir), "at", briefs.brief_step(LEAST)).select(*BRIEF_COLUMNS)


@query(RUNNING)
def stream_running_brief(spark, sf_dir):
    """The same over a stream whose records come out of order."""
    stream = in_batches(timed(spark, sf_dir), 3, F.col("ordinal"))
    return run_to_end(briefs.brief_stream(stream, "at", "30 days", briefs.brief_step(LEAST))).where("file_id IS NOT NULL").select(*BRIEF_COLUMNS)


@query("SELECT DISTINCT sha256(text) AS sha FROM conversations")
def stream_dedup(spark, sf_dir):
    """Turns that come again within the delay are dropped; all of these arrive at one time."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    stream = spark.readStream.schema(turns.schema).parquet(f"{sf_dir}/conversations.parque[t]")
    rows = stream.select(F.sha2("text", 256).alias("sha"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    return run_to_end(streaming.dedup_stream(rows, "at", "1 hour", "sha")).select("sha")


@query(CHUNKS)
def stream_chunks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")
    return run_to_end(streaming.chunk_stream(stream, ["doc_id"]))


@query(f"SELECT record_id, sha256(input_text) AS question, sha256(output_text) AS answer, true AS logged FROM {RECS}")
def stream_capture(spark, sf_dir):
    """Records as they come, each batch appended to the log and added to the index; the log is read back beside it."""
    root, own = shared(spark), recs(spark, sf_dir).select("record_id", "input_text", "output_text")
    own.write.parquet(f"{root}/in")
    streaming.capture(spark, f"{root}/in", _ddl(own), f"{root}/log", f"{root}/store", f"{root}/check").awaitTermination()
    logged = read_records(spark, f"{root}/log/*").select("record_id", F.lit(True).alias("logged"))
    rows = streaming.stored(spark, f"{root}/store", _ddl(own)).join(logged, "record_id", "left")
    return rows.select("record_id", F.sha2("input_text", 256).alias("question"), F.sha2("output_text", 256).alias("answer"), F.coalesce("logged", F.lit(False)).alias("logged"))
