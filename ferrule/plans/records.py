"""Queries of records' forms, edits, hydration of candidates, evidence texts and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import gate, ingest, memory, render, retrieval
from . import streams
from .ingest import CHUNKS
from .memory import HITS, RECS, TOP_FINAL, hits, recs, top_parents
from .registry import query, table
from .retrieval import SPARSE_TOP, sparse_list
from .texts import STRIP

CANDIDATE = "CASE id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'gone/' || id ELSE source || '/' || id END"
NUMBER = "CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 99999 WHEN 2 THEN -1 ELSE 0 END"


@query(f"""SELECT s.id, s.rank, c.chunk_idx, c.chunk FROM ({SPARSE_TOP}) s JOIN documents d ON d.doc_id = s.id JOIN ({CHUNKS}) c ON c.doc_id = s.id AND c.chunk_idx = {NUMBER} WHERE s.id % 5 > 1""")
def hydrate_valid(spark, sf_dir):
    """Candidates with blank paths, files that aren't there, and numbers that are null or out of range; only whole ones get their chunk."""
    c, docs = F.col, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    chosen = docs.join(F.broadcast(sparse_list(spark, sf_dir)), "id")
    path = F.when(c("id") % 5 == 0, " ").when(c("id") % 5 == 1, F.concat(F.lit("gone/"), c("id"))).otherwise(F.concat_ws("/", "source", "id"))
    number = F.when(c("id") % 7 == 0, None).when(c("id") % 7 == 1, 99_999).when(c("id") % 7 == 2, -1).otherwise(0).cast("long")
    chunks = ingest.chunk_rows(chosen.select(F.concat_ws("/", "source", "id").alias("path"), "text"), ["path"])
    return retrieval.hydrate_valid(chosen.select("id", "rank", path.alias("path"), number.alias("chunk_idx")), chunks).select("id", "rank", "chunk_idx", "chunk")


@query(f"""SELECT record_id, CASE ordinal % 4 WHEN 0 THEN 'Gold' ELSE tag END AS tag, CASE WHEN ordinal % 4 IN (0, 2) THEN CASE ordinal % 6 WHEN 0 THEN 'A' ELSE 'QA' END ELSE mode END AS retrieval_source_mode,
CASE ordinal % 4 WHEN 0 THEN 'key' ELSE '' END AS direct_recall_key, CASE ordinal % 4 WHEN 0 THEN 'x,y' ELSE 'own' END AS keywords,
ordinal % 4 = 0 OR (ordinal % 4 = 2 AND CASE ordinal % 6 WHEN 0 THEN 'A' ELSE 'QA' END <> mode) AS changed FROM {RECS}""")
def mem_gui_edits(spark, sf_dir):
    """Edits of some records: known and unknown tags, odd modes, keys with spaces, null keywords; and edits of records that aren't there."""
    c, words = F.col, lambda *w: F.array(*map(F.lit, w))
    own = recs(spark, sf_dir).select("record_id", "ordinal", "tag", c("mode").alias("retrieval_source_mode"), F.lit("").alias("direct_recall_key"), words("own").alias("user_keywords"))
    some = own.where("ordinal % 2 = 0")
    first = c("ordinal") % 4 == 0
    edits = some.select(F.concat(F.lit(" "), "record_id").alias("record_id"), F.when(first, " Gold").otherwise("Purple").alias("tag"), F.when(first, words("x", "y")).alias("user_keywords"), F.when(c("ordinal") % 6 == 0, "a ").otherwise("both").alias("retrieval_source_mode"), F.when(first, " key ").alias("direct_recall_key"))
    unknown = edits.limit(3).withColumn("record_id", F.concat(F.lit("nobody"), "record_id")).unionByName(edits.limit(1).withColumn("record_id", F.lit(" ")))
    return memory.sync_edits(own, edits.unionByName(unknown)).select("record_id", "tag", "retrieval_source_mode", "direct_recall_key", F.array_join("user_keywords", ",").alias("keywords"), "changed")


@query(f"""SELECT record_id, CASE WHEN ordinal % 3 = 1 THEN '' WHEN ordinal % 3 = 2 THEN '' ELSE 'a,' || tag END AS auto_keywords, CASE WHEN ordinal % 2 = 0 THEN '' ELSE mode END AS user_keywords FROM {RECS}""")
def index_rows(spark, sf_dir):
    """Index rows with lists as JSON: whole ones, broken ones, nulls."""
    c = F.col
    auto = F.when(c("ordinal") % 3 == 0, F.to_json(F.array(F.lit("a"), "tag"))).when(c("ordinal") % 3 == 1, '["a", ')
    rows = recs(spark, sf_dir).select("record_id", auto.alias("auto_keywords"), F.when(c("ordinal") % 2 == 0, "[]").otherwise(F.to_json(F.array("mode"))).alias("user_keywords"))
    return memory.index_rows(rows).select("record_id", F.array_join("auto_keywords", ",").alias("auto_keywords"), F.array_join("user_keywords", ",").alias("user_keywords"))


@query(f"""SELECT record_id, form, n_fields, tag, sha256(text) AS text FROM (SELECT record_id, unnest(['log', 'index', 'full']) AS form, unnest([11, 13, 18]) AS n_fields, unnest([NULL, tag, tag]) AS tag, unnest([input_text, '', input_text]) AS text FROM {RECS})""")
def record_forms(spark, sf_dir):
    """Every record in the three forms it has: in the log, in the index, and whole; fields that aren't there have defaults."""
    own = recs(spark, sf_dir).select("record_id", "tag", F.col("mode").alias("retrieval_source_mode"), "input_text", "output_text")
    out = None
    for name, fields in (("log", memory.LOG_FIELDS), ("index", memory.INDEX_FIELDS), ("full", memory.FULL_FIELDS)):
        form = memory.record_form(own, fields)
        tag = F.col("tag") if "tag" in form.columns else F.lit(None).cast("string")
        text = F.col("input_text") if "input_text" in form.columns else F.lit("")
        one = form.select("record_id", F.lit(name).alias("form"), F.lit(len(form.columns)).alias("n_fields"), tag.alias("tag"), F.sha2(text, 256).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


PLACED = f"(SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ordinal DESC, record_id DESC) AS pos FROM {RECS} WHERE tag <> 'Black')"


def _line(name: str, value: str) -> str:
    return f"'{name}: ' || {value} || chr(10)"


@query(f"""SELECT file_id, array_to_string(list_filter([e, c], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS text FROM (SELECT file_id,
'## Reduced Episodic Memory Episodes' || chr(10) || chr(10) || string_agg(CASE WHEN side = 0 THEN line END, chr(10) || chr(10) ORDER BY pos) AS e, '## Semantic Memory Chunks' || chr(10) || chr(10) || string_agg(CASE WHEN side = 1 THEN line END, chr(10) || chr(10) ORDER BY pos) AS c FROM (
SELECT t.file_id, 0 AS side, row_number() OVER (PARTITION BY t.file_id ORDER BY t.final_score DESC, t.record_id) AS pos, '### Episode ' || row_number() OVER (PARTITION BY t.file_id ORDER BY t.final_score DESC, t.record_id) || chr(10) || {_line('record_id', 't.record_id')} || {_line('tag', 't.tag')} || {_line('source', "'semantic'")}
|| chr(10) || 'QUESTION:' || chr(10) || {STRIP.format('r.input_text')} || chr(10) || chr(10) || 'ANSWER:' || chr(10) || {STRIP.format('r.output_text')} AS line FROM {TOP_FINAL} t JOIN {RECS} r USING (record_id)
UNION ALL SELECT file_id, 1, pos, '### Semantic Chunk ' || pos || chr(10) || {_line('vector_id', 'vector_id')} || {_line('record_id', 'record_id')} || {_line('role', 'role')} || chr(10) || 'TEXT:' || chr(10) || text FROM (
SELECT r.file_id, h.vector_id, h.record_id, h.role, CASE h.role WHEN 'question' THEN {STRIP.format('r.input_text')} ELSE {STRIP.format('r.output_text')} END AS text, row_number() OVER (PARTITION BY r.file_id ORDER BY h.score DESC, h.vector_id) AS pos
FROM {HITS} h JOIN {RECS} r USING (record_id) WHERE h.role <> 'record_handle' AND r.file_id % 2 = 0 QUALIFY pos <= 2)) GROUP BY 1)""")
def memory_evidence(spark, sf_dir):
    """The best parents of every file, and the best chunks of half of the files, as one text each."""
    c, own = F.col, recs(spark, sf_dir)
    texts = own.select("record_id", "input_text", "output_text")
    best = top_parents(spark, sf_dir).join(texts, "record_id").withColumns({"pos": F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("final_score"), "record_id")), "source": F.lit("semantic"), "score": F.lit("")})
    scored = hits(spark, sf_dir).where("role <> 'record_handle'").join(own.where("file_id % 2 = 0").select("record_id", "file_id", "input_text", "output_text"), "record_id")
    chunks = scored.withColumn("pos", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("score"), "vector_id"))).where("pos <= 2")
    chunks = chunks.withColumns({"text": F.when(c("role") == "question", c("input_text")).otherwise(c("output_text")), "score": F.lit(None).cast("string")})
    return render.memory_evidence(best, chunks)


@query(f"""SELECT file_id, record_id, row_number() OVER (PARTITION BY file_id ORDER BY place, record_id) AS pos FROM (
SELECT file_id, record_id, CASE WHEN file_id % 5 IN (0, 3) THEN -pos WHEN file_id % 5 = 1 THEN ordinal % 3 ELSE pos END AS place, file_id % 5 IN (0, 3) AND pos > 4 OR file_id % 5 = 1 AND pos % 2 = 0 AS out FROM {PLACED}) WHERE NOT out""")
def chunk_order(spark, sf_dir):
    """Orders by stage and by what a prompt has: a3's view before the final selection, that before another stage's view, the base order last."""
    c = F.col
    back = Window.partitionBy("file_id").orderBy(F.desc("ordinal"), F.desc("record_id"))
    base = memory.without_tags(recs(spark, sf_dir)).select("file_id", F.col("record_id").alias("id"), "ordinal", F.row_number().over(back).alias("pos"))
    five = c("file_id") % 5
    requests = base.select("file_id").distinct().withColumn("stage", F.when(five.isin(0, 1), "a3").when(five == 3, "a4").otherwise("retrieval"))
    views = base.where(five.isin(0, 3) & (c("pos") <= 4)).select("file_id", F.when(five == 0, "a3").otherwise("a4").alias("stage"), "id", (-c("pos")).alias("pos"))
    stray = views.withColumns({"id": F.concat(F.lit("stray "), "id"), "pos": F.lit(-99)})
    final = base.where(five.isin(0, 1) & (c("pos") % 2 == 1)).select("file_id", "id", (c("ordinal") % 3).alias("pos"))
    ordered = render.chunk_order(requests, views.unionByName(stray), final, base.select("file_id", "id", "pos"), "file_id")
    return ordered.select("file_id", c("id").alias("record_id"), "pos")


@query(f"""SELECT materiality, relation, (materiality = 'WEAK' AND relation IN ('SAME_TOPIC', 'RELATED_DOMAIN')) AS brief_for_retrieval, relation <> 'IRRELEVANT' AS memory_allowed, count(*) AS n FROM (
SELECT CASE route WHEN 'init_no_previous_activebrief' THEN 'NO_ACTIVEBRIEF' WHEN 'activebrief_update' THEN 'SAME_TOPIC' WHEN 'pending_topic_shift' THEN 'RELATED_DOMAIN' ELSE 'IRRELEVANT' END AS relation, CASE WHEN n >= 4 THEN 'STRONG' ELSE 'WEAK' END AS materiality
FROM ({streams.RUNNING}) b JOIN (SELECT record_id, len({streams.OWN}) AS n FROM {RECS}) w USING (record_id)) GROUP BY 1, 2""")
def route_decisions(spark, sf_dir):
    """What the running brief's routes lead to: the relation by the route, the materiality by how much a record says."""
    from ..operators import briefs

    rows = streams.timed(spark, sf_dir)
    said = briefs.encoded(rows).select("record_id", F.when(F.size("windows") >= 4, "STRONG").otherwise("WEAK").alias("materiality"))
    init, _, _, update, shift, _ = gate.ROUTES
    route = F.col("route")
    relation = F.when(route == init, "NO_ACTIVEBRIEF").when(route == update, "SAME_TOPIC").when(route == shift, "RELATED_DOMAIN").otherwise("IRRELEVANT")
    states = briefs.running_briefs(rows, "at", briefs.brief_step(streams.LEAST)).select("record_id", relation.alias("relation")).join(said, "record_id")
    counted = states.groupBy("materiality", "relation").agg(F.count("*").alias("n"))
    return gate.decide(counted).select("materiality", "relation", "brief_for_retrieval", "memory_allowed", "n")


@query(f"SELECT record_id, CASE WHEN ordinal % 3 = 0 THEN 'QA' WHEN ordinal % 3 = 1 THEN mode ELSE 'QA' END AS mode FROM {RECS}")
def txt_clean_mode(spark, sf_dir):
    """Modes as they are written by hand: blank, in lower case with spaces, or unknown."""
    given = F.when(F.col("ordinal") % 3 == 0, " ").when(F.col("ordinal") % 3 == 1, F.concat(F.lit(" "), F.lower("mode"))).otherwise("every")
    return recs(spark, sf_dir).select("record_id", fn.clean_mode(given).alias("mode"))
