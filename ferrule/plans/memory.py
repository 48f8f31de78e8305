"""Queries of conversational memory. A record is a user turn with the assistant turn after it; its vectors are
those of embeddings that a fixed rule of conversation and turn gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import vectors as vec
from ..operators import memory
from .registry import query, table

N_VECTORS = "(SELECT count(*) FROM embeddings)"


def recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.records(table(spark, sf_dir, "conversations"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, vector_id, record_id, role, score: each record has a handle, a question and an answer vector."""
    roles = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(i).alias("i")) for i, r in enumerate(("record_handle", "question", "answer")))))
    n = F.broadcast(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n")))  # one row
    rows = recs(spark, sf_dir).crossJoin(n).select("record_id", "n", (F.col("file_id") * 7 + F.col("ordinal") * 3).alias("base"), roles.alias("r"))
    rows = rows.select("record_id", F.col("r.role").alias("role"), ((F.col("base") + F.col("r.i")) % F.col("n")).alias("vec_id"))
    one = F.broadcast(table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query")))
    stored = table(spark, sf_dir, "embeddings").crossJoin(one).select("vec_id", vec.squared_distance(F.col("embedding"), F.col("query")).alias("distance"))
    return rows.join(stored, "vec_id").select(F.lit(0).alias("query_id"), F.concat_ws("::", "record_id", "role").alias("vector_id"), "record_id", "role", vec.distance_score(F.col("distance")).alias("score"))


RECS = """(SELECT conv_id AS file_id, conv_id || '-' || turn AS record_id, turn AS ordinal, text AS input_text, answer AS output_text,
CASE WHEN turn % 10 = 0 THEN 'Gold' WHEN turn % 10 = 7 THEN 'Black' ELSE 'Green' END AS tag, CASE turn % 3 WHEN 0 THEN 'QA' WHEN 1 THEN 'Q' ELSE 'A' END AS mode
FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant' AND trim(answer) <> '')"""
DISTANCE = f"(SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ordinal DESC, record_id DESC) - 1 AS k, count(*) OVER (PARTITION BY file_id) AS total FROM {RECS})"
HITS = f"""(SELECT r.record_id, r.record_id || '::' || r.role AS vector_id, r.role, 1 / (1 + v.d) AS score
FROM (SELECT record_id, file_id, ordinal, unnest(['record_handle', 'question', 'answer']) AS role, unnest([0, 1, 2]) AS i FROM {RECS}) r
JOIN (SELECT e.vec_id, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: pow(CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE), 2))) AS d
      FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q) v ON v.vec_id = (r.file_id * 7 + r.ordinal * 3 + r.i) % {N_VECTORS})"""
PARENTS = f"""(SELECT h.record_id, max(CASE WHEN role = 'question' THEN score END) AS question_score, max(CASE WHEN role = 'answer' THEN score END) AS answer_score,
max(CASE WHEN role NOT IN ('question', 'answer') THEN score END) AS meta_score, count(*) AS hit_count FROM {HITS} h GROUP BY 1)"""
FINAL = f"""(SELECT *, CASE WHEN tag = 'Gold' THEN semantic_score ELSE 0.75::DOUBLE * semantic_score + 0.25::DOUBLE * pow(2, -k / 10.0::DOUBLE) END AS final_score FROM (
SELECT p.*, d.file_id, d.tag, d.mode, d.k, CASE d.mode WHEN 'A' THEN 0.85::DOUBLE * answer_score + 0.15::DOUBLE * meta_score WHEN 'Q' THEN 0.85::DOUBLE * question_score + 0.15::DOUBLE * meta_score
ELSE 0.55::DOUBLE * answer_score + 0.35::DOUBLE * question_score + 0.1::DOUBLE * meta_score END AS semantic_score FROM {PARENTS} p JOIN {DISTANCE} d USING (record_id) WHERE d.tag <> 'Black'))"""
TOP_FINAL = f"(SELECT * FROM {FINAL} QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY final_score DESC, record_id) <= 3)"
GOLD = f"(SELECT * FROM {RECS} WHERE tag = 'Gold' QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ordinal DESC, record_id DESC) <= 1)"
UNION = f"""(SELECT file_id, record_id, source, row_number() OVER (PARTITION BY file_id ORDER BY priority, minus, record_id) AS pos FROM (
SELECT file_id, record_id, source, priority, minus FROM (SELECT file_id, record_id, 'gold' AS source, 0 AS priority, 0.0::DOUBLE AS minus FROM {GOLD}
UNION ALL SELECT file_id, record_id, 'semantic', 1, -final_score FROM {TOP_FINAL}) QUALIFY row_number() OVER (PARTITION BY file_id, record_id ORDER BY priority, minus) = 1) QUALIFY pos <= 3)"""
WORKING = f"(SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ordinal DESC, record_id DESC) AS pos FROM {RECS} WHERE tag <> 'Black' QUALIFY pos <= 2)"

RECALL = f"""SELECT recall_key, record_id, file_id, tag, ordinal FROM (SELECT 'k' || ordinal % 13 AS recall_key, * FROM {RECS} WHERE tag <> 'Black') WHERE recall_key IN ('k0', 'k3', 'k5', 'k12')
QUALIFY row_number() OVER (PARTITION BY recall_key ORDER BY CASE tag WHEN 'Gold' THEN 0 WHEN 'Green' THEN 1 ELSE 2 END, ordinal DESC, record_id) = 1"""
CHUNK_TOP = f"""SELECT vector_id, round(s, 6) AS chunk_score FROM (SELECT h.vector_id, CASE WHEN d.tag = 'Gold' THEN h.score ELSE 0.9::DOUBLE * h.score + 0.1::DOUBLE * pow(2, -d.k / 10.0::DOUBLE) END AS s
FROM {HITS} h JOIN {DISTANCE} d USING (record_id) WHERE h.role IN ('question', 'answer') AND d.tag <> 'Black') ORDER BY s DESC, vector_id LIMIT 5"""


def final_parents(spark, sf_dir):
    return memory.parents(hits(spark, sf_dir), recs(spark, sf_dir))


def top_parents(spark, sf_dir, n: int = 3):
    from pyspark.sql import Window

    order = Window.partitionBy("file_id").orderBy(F.desc("final_score"), "record_id")
    return final_parents(spark, sf_dir).withColumn("i", F.row_number().over(order)).where(F.col("i") <= n).drop("i")


@query(f"SELECT file_id, record_id, ordinal, input_text, output_text, tag, mode FROM {RECS}")
def mem_pairs(spark, sf_dir):
    return recs(spark, sf_dir)


@query(f"SELECT file_id, record_id, pos FROM {WORKING}")
def mem_working(spark, sf_dir):
    return memory.latest(recs(spark, sf_dir), 2).select("file_id", "record_id", "pos")


@query(f"SELECT file_id, record_id FROM {GOLD}")
def mem_gold(spark, sf_dir):
    return memory.latest(recs(spark, sf_dir), 1, ("Gold",)).select("file_id", "record_id")


@query(RECALL)
def mem_direct_recall(spark, sf_dir):
    keys = spark.createDataFrame([("k0",), ("k3",), ("k5",), ("k12",)], "recall_key string")
    keyed = recs(spark, sf_dir).withColumn("recall_key", F.concat(F.lit("k"), (F.col("ordinal") % 13).cast("string")))
    return memory.direct_recall(keyed, F.broadcast(keys))


@query(f"SELECT file_id, record_id, k, total, total - 1 - k AS idx FROM {DISTANCE}")
def mem_episode_distance(spark, sf_dir):
    return memory.episode_distance(recs(spark, sf_dir)).select("file_id", "record_id", "k", "total", "idx")


@query(f"SELECT record_id, round(pow(2, -k / 10.0::DOUBLE), 9) AS recency FROM {DISTANCE}")
def mem_recency(spark, sf_dir):
    return memory.episode_distance(recs(spark, sf_dir)).select("record_id", F.round(vec.recency(F.col("k")), 9).alias("recency"))


@query(f"SELECT vector_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vector_id) AS rank FROM {HITS} ORDER BY 3 LIMIT 20")
def mem_hits(spark, sf_dir):
    found = memory.scored_hits(hits(spark, sf_dir).withColumn("distance", F.lit(None).cast("double")).orderBy(F.desc("score"), "vector_id").limit(20))
    return found.select("vector_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT record_id, round(question_score, 6) AS question_score, round(answer_score, 6) AS answer_score, round(meta_score, 6) AS meta_score, hit_count, round(semantic_score, 6) AS semantic_score, round(final_score, 6) AS final_score FROM {FINAL}")
def mem_parent_scores(spark, sf_dir):
    names = ("question_score", "answer_score", "meta_score", "semantic_score", "final_score")
    return final_parents(spark, sf_dir).select("record_id", "hit_count", *(F.round(n, 6).alias(n) for n in names))


@query(CHUNK_TOP)
def mem_semantic_chunks(spark, sf_dir):
    return memory.semantic_chunks(hits(spark, sf_dir), recs(spark, sf_dir)).select("vector_id", F.round("chunk_score", 6).alias("chunk_score"))


@query(f"SELECT file_id, record_id, source, pos FROM {UNION}")
def mem_gold_union(spark, sf_dir):
    return memory.gold_union(memory.latest(recs(spark, sf_dir), 1, ("Gold",)), top_parents(spark, sf_dir))


@query(f"SELECT slot, count(*) AS n FROM (SELECT 'working' AS slot FROM {WORKING} UNION ALL SELECT 'episodic' FROM {UNION} UNION ALL SELECT 'semantic_chunk' FROM ({CHUNK_TOP}) UNION ALL SELECT 'direct_recall' FROM ({RECALL})) GROUP BY 1")
def mem_pack_counts(spark, sf_dir):
    """All four slots: the newest, the best of Gold and scored ones, best chunks, and records recalled by key."""
    own = recs(spark, sf_dir)
    chunks = memory.semantic_chunks(hits(spark, sf_dir), own)
    pack = memory.context_pack(memory.latest(own, 2), memory.gold_union(memory.latest(own, 1, ("Gold",)), top_parents(spark, sf_dir)), chunks, mem_direct_recall(spark, sf_dir))
    return pack.groupBy("slot").agg(F.count("*").alias("n"))


@query(f"SELECT file_id, count(*) AS n_records, string_agg(record_id, ',' ORDER BY ordinal, record_id) AS record_ids, min(ordinal) AS created, max(ordinal) AS updated, count(DISTINCT tag) AS n_tags FROM {RECS} GROUP BY 1")
def mem_metainfo(spark, sf_dir):
    return memory.metainfo(recs(spark, sf_dir))


@query(f"SELECT tag, count(*) AS n FROM {RECS} GROUP BY 1")
def mem_tag_summary(spark, sf_dir):
    return recs(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def mem_role_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"))


@query(f"SELECT record_id, CASE WHEN ordinal % 4 = 0 THEN 'Gold' ELSE tag END AS tag, ordinal % 4 = 0 AND tag <> 'Gold' AS changed FROM {RECS}")
def mem_overlay(spark, sf_dir):
    own = recs(spark, sf_dir)
    edits = own.where("ordinal % 2 = 0").select("record_id", F.when(F.col("ordinal") % 4 == 0, "Gold").otherwise(" ").alias("tag"))
    return memory.overlay(own.select("record_id", "tag"), edits, ["tag"])


@query(f"SELECT record_id, CASE WHEN ordinal % 2 = 0 THEN 'episode' WHEN ordinal % 3 = 0 THEN 'live' ELSE tag END AS tag FROM {RECS}")
def mem_enrich(spark, sf_dir):
    own = recs(spark, sf_dir)
    live = own.where("ordinal % 3 = 0").select("record_id", F.lit("live").alias("tag"))
    episodes = own.where("ordinal % 2 = 0").select("record_id", F.lit("episode").alias("tag"))
    return memory.enrich(own.select("record_id", "tag"), live, episodes, ["tag"])


@query(f"SELECT r.record_id, r.tag FROM {RECS} r WHERE r.file_id = 3 AND r.ordinal % 2 = 0")
def mem_by_ids(spark, sf_dir):
    own = recs(spark, sf_dir)
    wanted = own.where("file_id = 3 AND ordinal % 2 = 0").select("record_id")
    return own.where("file_id = 3").join(wanted, "record_id", "left_semi").select("record_id", "tag")


@query(f"SELECT file_id, max(ordinal) AS updated FROM {RECS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def mem_histories(spark, sf_dir):
    return recs(spark, sf_dir).groupBy("file_id").agg(F.max("ordinal").alias("updated")).orderBy(F.desc("updated"), "file_id").limit(20)


BRIEFS = f"(SELECT *, CASE WHEN ordinal % 4 = 0 THEN '' ELSE output_text END AS brief FROM {RECS})"


def briefs(spark, sf_dir):
    return recs(spark, sf_dir).withColumn("brief", F.when(F.col("ordinal") % 4 == 0, "").otherwise(F.col("output_text")))


@query(f"SELECT file_id, record_id, brief FROM {BRIEFS} WHERE tag <> 'Black' AND brief <> '' QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ordinal DESC, record_id DESC) = 1")
def latest_brief(spark, sf_dir):
    return memory.latest_brief(briefs(spark, sf_dir))


@query(f"""SELECT file_id, record_id, brief FROM (SELECT *, lag(tag) OVER (PARTITION BY file_id ORDER BY ordinal) AS before_tag FROM {BRIEFS}) WHERE tag <> 'Black' AND brief <> '' AND coalesce(before_tag, '') <> 'Black'
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ordinal DESC, record_id DESC) = 1""")
def clean_brief_anti(spark, sf_dir):
    """A brief's contributors are its record and the one before it."""
    from pyspark.sql import Window

    before = F.lag("record_id").over(Window.partitionBy("file_id").orderBy("ordinal"))
    return memory.clean_brief(briefs(spark, sf_dir).withColumn("contributors", F.array_compact(F.array("record_id", before))))


@query(f"SELECT file_id, record_id, trim(input_text) AS query_text FROM {RECS} WHERE tag = 'Gold'")
def mem_query_text(spark, sf_dir):
    gold = recs(spark, sf_dir).where("tag = 'Gold'")
    return gold.select("file_id", "record_id", memory.first_filled(F.lit(None).cast("string"), F.lit("  "), F.col("input_text")).alias("query_text"))


@query(f"SELECT record_id, greatest(1, floor(length(output_text) / 4)::INT) AS tokens, round(length(input_text) * 1.0, 1)::DOUBLE AS n FROM {RECS}")
def mem_token_estimate(spark, sf_dir):
    return recs(spark, sf_dir).select("record_id", fn.json_token_estimate(F.col("output_text")).alias("tokens"), F.length("input_text").cast("double").alias("n"))
