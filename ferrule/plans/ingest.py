"""Queries of ingestion, predicates and sources. A document's path is source/doc_id; its earlier and later state follow doc_id."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import ingest, predicates
from ..sources import files
from ..sources.shared import shared_dir
from .registry import query, table

def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk_rows(table(spark, sf_dir, "documents"), ["doc_id"])


def before_and_now(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")).alias("path"), "text")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" (new)"))).otherwise(F.col("text"))
    named = lambda df, text: df.select("doc_id", "path", fn.text_sha(text).alias("sha256"), text.alias("text"))
    return named(docs.where("doc_id % 10 <> 0"), F.col("text")), named(docs.where("doc_id % 10 <> 1"), changed)


STRIP = r"regexp_replace({}, '^[\s\x0B\x85\xA0]+|[\s\x0B\x85\xA0]+$', '', 'g')"
CHUNKS = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_idx, start, least(start + 1200, length(text)) AS "end", chunk
FROM (SELECT doc_id, text, start, {STRIP.format("substr(text, start + 1, 1200)")} AS chunk
      FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1080)) AS start FROM documents)) WHERE chunk <> ''"""
BEFORE = "SELECT doc_id, source || '/' || doc_id AS path, sha256(text) AS sha256, text FROM documents WHERE doc_id % 10 <> 0"
NOW = "SELECT doc_id, source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' (new)' ELSE text END) AS sha256, CASE WHEN doc_id % 7 = 0 THEN text || ' (new)' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1"
DIFF = f"""SELECT path, CASE WHEN n.sha256 IS NULL THEN 'removed' WHEN b.sha256 IS NULL THEN 'new' WHEN b.sha256 = n.sha256 THEN 'unchanged' ELSE 'changed' END AS status,
coalesce(n.sha256, b.sha256) AS sha256 FROM ({BEFORE}) b FULL JOIN ({NOW}) n USING (path)"""


@query(CHUNKS)
def chunk_documents(spark, sf_dir):
    return chunked(spark, sf_dir)


@query(f"SELECT item_id, chunk_idx, piece FROM (SELECT doc_id AS item_id, chunk_idx, chunk AS piece FROM ({CHUNKS.replace('documents', '(SELECT item_id AS doc_id, text FROM benchmark)')}))")
def query_pieces(spark, sf_dir):
    return ingest.chunk_rows(table(spark, sf_dir, "benchmark"), ["item_id"]).select("item_id", "chunk_idx", F.col("chunk").alias("piece"))


@query(f"SELECT d.source, CAST(sum(octet_length(encode(chunk))) AS BIGINT) AS bytes, count(*) AS n_chunks FROM ({CHUNKS}) c JOIN documents d USING (doc_id) GROUP BY 1")
def embedded_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ingest.chunk_rows(docs, ["source"]).groupBy("source").agg(F.sum(F.octet_length("chunk")).cast("long").alias("bytes"), F.count("*").alias("n_chunks"))


@query(DIFF)
def manifest_diff(spark, sf_dir):
    return ingest.manifest_diff(*before_and_now(spark, sf_dir))


@query(f"SELECT path, sha256 FROM ({BEFORE}) WHERE path NOT IN (SELECT path FROM ({NOW}))")
def tombstones(spark, sf_dir):
    before, now = before_and_now(spark, sf_dir)
    return ingest.delete_keys(before, now, ["path"]).select("path", "sha256")


@query(f"""SELECT coalesce(n.path, b.path) AS path, coalesce(n.sha256, b.sha256) AS sha256 FROM ({BEFORE}) b FULL JOIN ({NOW}) n USING (path)""")
def upsert_latest(spark, sf_dir):
    before, now = before_and_now(spark, sf_dir)
    return ingest.upsert(before.select("path", "sha256"), now.select("path", "sha256"), "path")


@query(f"SELECT b.path, b.sha256 FROM ({BEFORE}) b WHERE NOT EXISTS (SELECT 1 FROM ({NOW}) n WHERE n.path = b.path AND n.sha256 = b.sha256)")
def delete_version(spark, sf_dir):
    before, now = before_and_now(spark, sf_dir)
    return ingest.delete_keys(before, now, ["path", "sha256"]).select("path", "sha256")


@query(f"SELECT b.path FROM ({BEFORE}) b WHERE path IN (SELECT path FROM ({NOW}))")
def keep_live(spark, sf_dir):
    before, now = before_and_now(spark, sf_dir)
    return ingest.keep_live(before, now, ["path"]).select("path")


@query("SELECT CAST(count_if(NOT (source = 'src3' AND lang = 'en')) AS BIGINT) AS n_left, CAST(count_if(source = 'src3' AND lang = 'en') AS BIGINT) AS n_deleted FROM documents")
def delete_where(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang")
    left = ingest.delete_where(docs, {"$and": [{"source": "src3"}, {"lang": "en"}]}).agg(F.count("*").alias("n_left"))
    return left.crossJoin(docs.agg(F.count("*").alias("n"))).select("n_left", (F.col("n") - F.col("n_left")).alias("n_deleted"))


@query("SELECT doc_id, fingerprint FROM (SELECT doc_id, sha256(lang || chr(31) || text) AS fingerprint, row_number() OVER (PARTITION BY sha256(lang || chr(31) || text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", fn.text_sha(F.concat_ws("\x1f", "lang", "text")).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fingerprint")


@query(f"""SELECT CAST(count_if(status <> 'removed') AS BIGINT) AS scanned, CAST(count_if(status IN ('new', 'changed')) AS BIGINT) AS to_process, CAST(count_if(status = 'unchanged') AS BIGINT) AS unchanged, CAST(count_if(status = 'removed') AS BIGINT) AS tombstones,
(SELECT count(*) FROM ({CHUNKS})) AS chunks, (SELECT CAST(sum(octet_length(encode(chunk))) AS BIGINT) FROM ({CHUNKS})) AS bytes FROM ({DIFF})""")
def ingest_stats(spark, sf_dir):
    return ingest.ingest_stats(ingest.manifest_diff(*before_and_now(spark, sf_dir)), chunked(spark, sf_dir))


@query("SELECT doc_id, source, lang FROM documents WHERE (source = 'src1' OR source = 'src2') AND lang = 'en'")
def where_and_or(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return predicates.apply_where(docs, {"$and": [{"$or": [{"source": "src1"}, {"source": "src2"}]}, {"lang": "en", "gone": None}]})


@query("SELECT conv_id, turn FROM conversations WHERE CASE WHEN turn % 10 = 0 THEN 'Gold' WHEN turn % 10 = 7 THEN 'Black' ELSE '' END NOT IN ('Black')")
def tag_exclude(spark, sf_dir):
    tag = F.when(F.col("turn") % 10 == 0, "Gold").when(F.col("turn") % 10 == 7, "Black").otherwise("")
    return predicates.without_tags(table(spark, sf_dir, "conversations").withColumn("tag", tag)).select("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND role IN ('user', 'assistant')")
def file_scope(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return predicates.apply_where(turns, {"conv_id": 3}).where(F.col("role").isin("user", "assistant"))


@query("SELECT name FROM (SELECT source AS name FROM documents UNION SELECT role FROM conversations UNION SELECT event_type FROM events)")
def projects_union(spark, sf_dir):
    return files.projects(table(spark, sf_dir, "documents").selectExpr("source AS name"), table(spark, sf_dir, "conversations").selectExpr("role AS name"), table(spark, sf_dir, "events").selectExpr("event_type AS name"))


@query("SELECT DISTINCT regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def embedded_files(spark, sf_dir):
    return files.embedded_files(table(spark, sf_dir, "pages").selectExpr("url AS path"))


@query("SELECT page_id, CASE WHEN NOT (lower(url) LIKE '%.txt' OR lower(url) LIKE '%.md') THEN 'unsupported file type' END AS reason FROM pages")
def upload_filter(spark, sf_dir):
    return files.accepted(table(spark, sf_dir, "pages").selectExpr("page_id", "url AS path")).select("page_id", "reason")


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_sha(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.text_sha(F.col("text")).alias("sha"))


@query("""SELECT conv_id, turn, text FROM conversations WHERE role <> 'system'""")
def record_log_roundtrip(spark, sf_dir):
    """Turns written as delimited blocks and parsed again."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    record = F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"), F.col("text").alias("input_text"))
    parsed = turns.select("conv_id", "turn", F.explode(files.parse_records(files.render_record(record))).alias("r"))
    return parsed.select("conv_id", "turn", F.col("r.input_text").alias("text"))


@query("""SELECT 'all' AS sink, event_type, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'even', event_type, count(*) FROM events WHERE user_id % 2 = 0 GROUP BY 2""")
def log_routing(spark, sf_dir):
    sinks = spark.createDataFrame([("all", None, [0, 1]), ("even", None, [0])], "sink string, types array<string>, levels array<int>")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), (F.col("user_id") % 2).cast("int").alias("level"))
    types = events.select("type").distinct().agg(F.collect_set("type").alias("types"))
    routed = files.routed(events, sinks.drop("types").crossJoin(types))
    return routed.groupBy("sink", F.col("type").alias("event_type")).agg(F.count("*").alias("n"))


@query("""SELECT 'all' AS sink, event_type AS type, count(*) AS n, count(DISTINCT event_id) AS n_events FROM events GROUP BY 2 UNION ALL SELECT 'clicks', event_type, count(*), count(DISTINCT event_id) FROM events WHERE event_type = 'click' AND user_id % 3 = 0 GROUP BY 2""")
def log_written(spark, sf_dir):
    """Events written to the sinks that take their type and level, a folder each, in two lots, and read again."""
    root = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), (F.col("user_id") % 3).cast("int").alias("level"))
    types = [r[0] for r in events.select("type").distinct().orderBy("type").limit(1_000).collect()]  # kinds of events
    sinks = spark.createDataFrame([("all", types, [0, 1, 2]), ("clicks", ["click"], [0])], "sink string, types array<string>, levels array<int>")
    for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 <> 0")):
        files.write_sinks(part, sinks, root)
    return spark.read.schema("event_id long, type string, level int, sink string").json(root).groupBy("sink", "type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_events"))
