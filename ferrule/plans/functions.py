"""Queries of text functions, structured answers, stores and unions, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import vectors as vec
from ..operators import answers, gate, ingest, memory, predicates, prompt, render
from .ingest import BEFORE, CHUNKS, NOW, STRIP, before_and_now
from .memory import DISTANCE, HITS, RECALL, RECS, TOP_FINAL, WORKING, hits, mem_direct_recall, recs, top_parents
from .registry import query, table
from .texts import GATED, STATE, TRIMMED, gated, states


def _nested(start: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        start = f"regexp_replace({start}, '{pattern}', '{new}', 'g')"
    return STRIP.format(start)


MARKED = "'```py' || chr(10) || '#' || lang || chr(10) || '  ### ' || source || ' ' || chr(10) || '-----' || chr(10) || text || chr(10) || '####' || chr(10) || '```'"
LEVELS = [step for k in range(6, 0, -1) for step in ((rf"(?m)^([ \t]*)#{{{k}}}[ \t]*(\S.*?)[ \t]*$", rf"\1[H{k}] \2"), (rf"(?m)^([ \t]*)#{{{k}}}[ \t]*$", rf"\1[H{k}]"))]
FENCES = [(r"(?m)^([ \t]*)```[ \t]*(\S.*?)[ \t]*$", r"\1[CODE_FENCE] \2"), (r"(?m)^([ \t]*)```[ \t]*$", r"\1[CODE_FENCE]"), (r"(?m)^([ \t]*)-{3,}[ \t]*$", r"\1[RULE]")]
TIGHT = [*((rf"(?m)^#{{{k}}}[ \t]*", f"[H{k}] ") for k in (3, 2, 1)), ("(?m)^```", "[CODE_FENCE]"), (r"(?m)^---[ \t]*$", "[RULE]")]


def marked(spark, sf_dir):
    """Whole documents between headings, fences and rules."""
    body = F.concat(F.lit("```py\n#"), F.col("lang"), F.lit("\n  ### "), F.col("source"), F.lit(" \n-----\n"), F.col("text"), F.lit("\n####\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("text"))


@query(f"SELECT doc_id, sha256({_nested(MARKED, *FENCES, *LEVELS)}) AS sha FROM documents")
def txt_mask_structure(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", fn.text_sha(fn.mask_structure(F.col("text"))).alias("sha"))


@query(f"SELECT doc_id, sha256({_nested(MARKED, *TIGHT)}) AS sha FROM documents")
def txt_mask_tight(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", fn.text_sha(fn.mask_headings_tight(F.col("text"))).alias("sha"))


@query(r"SELECT page_id, trim(url) <> '' AND NOT contains(url, '/') AND NOT contains(url, '\') AND NOT contains(url, '..') AS whole, trim(name) <> '' AND NOT contains(name, '..') AS last FROM (SELECT *, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)")
def txt_project_name(spark, sf_dir):
    last = fn.valid_project_name(F.regexp_extract("url", "([^/]*)$", 1))
    return table(spark, sf_dir, "pages").select("page_id", fn.valid_project_name(F.col("url")).alias("whole"), last.alias("last"))


@query("SELECT doc_id, source || '|' || lang || CASE WHEN doc_id % 2 = 0 THEN '|extra' ELSE '' END AS keywords FROM documents")
def txt_split_keywords(spark, sf_dir):
    raw = F.concat(F.col("source"), F.lit(", "), F.col("lang"), F.lit("\n"), F.upper("lang"), F.lit(",, "), F.when(F.col("doc_id") % 2 == 0, "extra").otherwise(" "))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(fn.split_keywords(raw), "|").alias("keywords"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant,user' ELSE 'user' END AS roles, 'tool,assistant' AS other FROM conversations")
def txt_normalise_many(spark, sf_dir):
    role = F.col("role")
    values = F.array(role, F.concat(F.lit(" "), role), F.lit("user"), F.lit("no such"))
    roles = fn.normalise_many(values, ["tool", "assistant", "user"], 2)
    other = fn.normalise_many(F.array(F.upper("role")), ["tool", "assistant", "user"], 2, ["gone"])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(roles, ",").alias("roles"), F.array_join(other, ",").alias("other"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN ['QA', 'Q', 'A'][CAST(event_id % 4 + 1 AS INT)] ELSE 'QA' END AS mode, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(ts, '%Y-%m-%d-%H-%M') || '-' || event_type || '-x' AS name FROM events")
def txt_stamps(spark, sf_dir):
    """Modes brought to their three values, times as stamps, names of histories by time and title."""
    raw = F.element_at(F.array(F.lit(" qa"), F.lit("q "), F.lit("A"), F.lit("odd")), (F.col("event_id") % 4 + 1).cast("int"))
    name = fn.history_name(F.col("ts"), F.concat(F.lit(" ?"), F.col("event_type"), F.lit(" // x!")))
    return table(spark, sf_dir, "events").select("event_id", fn.clean_mode(raw).alias("mode"), fn.utc_stamp(F.col("ts")).alias("stamp"), name.alias("name"))


@query(f"SELECT d.source || '::' || sha256(d.text) || '::' || c.chunk_idx AS id FROM ({CHUNKS}) c JOIN documents d USING (doc_id)")
def chunk_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("sha", fn.text_sha(F.col("text")))
    return ingest.chunk_rows(docs, ["source", "sha"]).select(fn.chunk_id(F.col("source"), F.col("sha"), F.col("chunk_idx")).alias("id"))


@query("SELECT doc_id, CAST((n_chars % 3 <> 0)::INT + (doc_id % 2 <> 0)::INT AS BIGINT) AS n, n_chars % 3 * 2.0::DOUBLE + doc_id % 2 * 3.0::DOUBLE AS dot FROM documents")
def sparse_maps(spark, sf_dir):
    """Sparse vectors as maps: zeros and nulls go, products are summed over shared terms."""
    weights = F.create_map(F.lit("a"), (F.col("n_chars") % 3).cast("double"), F.lit("b"), (F.col("doc_id") % 2).cast("double"), F.lit("c"), F.lit(None).cast("double"))
    other = F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(3.0), F.lit("d"), F.lit(1.0))
    clean = vec.sparse_clean(weights)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(clean).cast("long").alias("n"), vec.sparse_dot(clean, other).alias("dot"))


@query("SELECT doc_id FROM documents WHERE n_chars >= 1500 AND (lang = 'en' OR doc_id = 7)")
def where_typed(spark, sf_dir):
    """A truth value, a number and a text, each compared as what it is."""
    docs = table(spark, sf_dir, "documents").withColumn("long", F.col("n_chars") >= 1500)
    return predicates.apply_where(docs, {"$and": [{"long": True}, {"$or": [{"lang": "en"}, {"doc_id": 7}]}]}).select("doc_id")


@query(f"SELECT record_id, CASE WHEN ordinal % 5 = 4 THEN 'NO_ACTIVEBRIEF' ELSE m || '_' || r END AS state FROM (SELECT *, {STATE} FROM {RECS})")
def relation_state(spark, sf_dir):
    relation = F.when(F.col("ordinal") % 5 == 4, "NO_ACTIVEBRIEF").otherwise(F.col("r"))
    return states(spark, sf_dir).select("record_id", gate.relation_state(F.col("m"), relation).alias("state"))


@query(f"SELECT record_id, '## TASK' || chr(10) || {TRIMMED['input_text']} || CASE WHEN ordinal % 2 = 0 THEN chr(10) || chr(10) || '## CONTEXT' || chr(10) || tag ELSE '' END || chr(10) || chr(10) || '## TONE' || chr(10) || mode AS prompt FROM {RECS}")
def prompt_blocks(spark, sf_dir):
    c = F.col
    fields = {"task": c("input_text"), "purpose": F.lit(None).cast("string"), "context": F.when(c("ordinal") % 2 == 0, c("tag")).otherwise("  "), "tone": c("mode")}
    return recs(spark, sf_dir).select("record_id", prompt.prompt_blocks(fields).alias("prompt"))


CLASS = "CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 END"


@query(f"""SELECT coalesce(string_agg('<group class="ID' || p || '">' || chr(10) || items || chr(10) || '</group>', chr(10) ORDER BY p), '<unclassified/>') AS xml
FROM (SELECT p, string_agg('  ' || id, chr(10) ORDER BY id) AS items FROM (SELECT g.id, {CLASS} AS p FROM {GATED} g JOIN documents d ON d.doc_id = g.id) WHERE p IS NOT NULL GROUP BY 1)""")
def render_class_groups(spark, sf_dir):
    """One request's candidates by class, at most as many as the gate lets in."""
    classes = spark.createDataFrame([("ID1", "en", "x", 1), ("ID2", "fr", "x", 2), ("ID3", "de", "x", 3)], "class_id string, phrase string, context string, priority int")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    items = docs.join(F.broadcast(gated(spark, sf_dir).select("id")), "id").select(F.col("id").alias("item"), F.col("lang").alias("answer"))
    return render.class_groups_xml(gate.group_classes(gate.assign_class(items, classes).where("class_id IS NOT NULL"), classes))


@query("SELECT source, string_agg(lang, '|' ORDER BY first) AS keywords FROM (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY 1, 2) GROUP BY 1")
def keyword_union(spark, sf_dir):
    """Per source the languages in order of appearance, written in two ways of which the first counts."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.array(F.col("lang"), F.upper("lang"), F.lit(" ")).alias("keywords"))
    return memory.keyword_union(docs, "source", "doc_id").select("source", F.array_join("keywords", "|").alias("keywords"))


@query(f"SELECT record_id, CASE WHEN before IS NULL THEN record_id ELSE before || ',' || record_id END AS ids FROM (SELECT record_id, lag(record_id) OVER (PARTITION BY file_id ORDER BY ordinal) AS before FROM {RECS})")
def contributors(spark, sf_dir):
    before = F.lag("record_id").over(Window.partitionBy("file_id").orderBy("ordinal"))
    rows = recs(spark, sf_dir).select("record_id", before.alias("before"))
    ids = memory.contributors(F.array("before", F.lit(" ")), F.array("record_id", "before", "record_id"))
    return rows.select("record_id", F.array_join(ids, ",").alias("ids"))


# ---- stores


@query(f"SELECT record_id, CASE WHEN ordinal % 3 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN ordinal % 3 = 0 THEN output_text ELSE input_text END AS text FROM {RECS} WHERE NOT (ordinal % 3 = 0 AND ordinal % 2 = 0)")
def mem_replace(spark, sf_dir):
    """Every third ordinal is touched; those that are even besides have no new rows, so they are deleted."""
    own = recs(spark, sf_dir)
    touched = own.where("ordinal % 3 = 0")
    new = touched.where("ordinal % 2 <> 0").select("record_id", F.lit("new").alias("state"), F.col("output_text").alias("text"))
    return ingest.replace_records(own.select("record_id", F.lit("old").alias("state"), F.col("input_text").alias("text")), new, touched)


@query(f"SELECT file_id, count(*) AS before, count(*) - count_if(tag = 'Black') AS after, CAST(count_if(tag = 'Black') AS BIGINT) AS deleted FROM {RECS} GROUP BY 1")
def mem_delete_counts(spark, sf_dir):
    own = recs(spark, sf_dir)
    return ingest.delete_counts(own, own.where("tag = 'Black'"), ["record_id"], "file_id")


@query(f"SELECT n.path, n.sha256, (SELECT count(*) FROM ({CHUNKS}) c JOIN ({BEFORE}) b USING (doc_id) WHERE b.path = n.path AND b.sha256 = n.sha256) AS n FROM ({NOW}) n")
def version_counts(spark, sf_dir):
    """Chunks that are stored of the versions that are there now: none of new and changed files."""
    before, now = before_and_now(spark, sf_dir)
    return ingest.count_versions(ingest.chunk_rows(before, ["path", "sha256"]), now)


# ---- answers

FIELDS = {
    "lang": answers.field_config({"options": [{"id": "en"}, {"id": "fr", "label": "French"}, "odd"], "default": "fr"}),
    "tags": answers.field_config({"options": [{"id": x} for x in ("src1", "src2", "src3")], "max_selected": 2, "default": ["src3"]}),
}


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'en' ELSE 'fr' END AS lang, CASE WHEN source IN ('src1', 'src2') THEN source || ',' || CASE source WHEN 'src1' THEN 'src2' ELSE 'src1' END
WHEN source = 'src3' THEN 'src3,src2' ELSE 'src2,src1' END AS tags FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'fr', 'src3' FROM documents WHERE doc_id % 3 = 0""")
def answer_selector(spark, sf_dir):
    """Answers with text around their JSON; every third one is broken, so defaults stand in."""
    said = F.to_json(F.struct("lang", F.array(F.col("source"), F.lit("none"), F.lit("src2"), F.lit("src1")).alias("tags")))
    answer = F.when(F.col("doc_id") % 3 == 0, "{no json").otherwise(F.concat(F.lit("Here it is: "), said, F.lit("\n")))
    got = answers.selected(answer, FIELDS)
    return table(spark, sf_dir, "documents").select("doc_id", got["lang"].alias("lang"), F.array_join(got["tags"], ",").alias("tags"))


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) || '-a' AS chunk_id, CASE WHEN quality = 1 THEN 'useful' ELSE 'borderline' END AS label FROM labels UNION ALL SELECT doc_id, 'b', 'discarded' FROM labels WHERE toxic = 1")
def answer_classifier(spark, sf_dir):
    """An item with a padded id, one only of toxic documents, and one without an id."""
    c = F.col
    field = {"label": answers.field_config({"options": [{"id": x} for x in ("useful", "borderline", "discarded")], "default": "borderline"})}
    item = lambda i, label: F.struct(i.alias("chunk_id"), label.alias("label"))
    items = F.array(item(F.concat(F.lit(" "), c("doc_id").cast("string"), F.lit("-a")), F.when(c("quality") == 1, " useful").otherwise("unknown")), item(F.when(c("toxic") == 1, "b"), F.lit("discarded")), item(F.lit(None).cast("string"), F.lit("useful")))
    said = table(spark, sf_dir, "labels").select("doc_id", F.to_json(F.struct(items.alias("item_decisions"))).alias("answer"))
    return answers.classified(said, "doc_id", field)


@query(f"SELECT record_id, {TRIMMED['output_text']} AS summary, '' AS title FROM {RECS}")
def answer_synthesizer(spark, sf_dir):
    got = answers.synthesised(F.to_json(F.struct(F.concat(F.lit("  "), F.col("output_text")).alias("summary"))), ["summary", "title"])
    return recs(spark, sf_dir).select("record_id", *(c.alias(n) for n, c in got.items()))


@query(f"""SELECT mode, count(*) AS calls, CAST(sum(length(input_text)) AS BIGINT) AS input, CAST(sum(CASE WHEN ordinal % 2 = 0 THEN ordinal ELSE 0 END) AS BIGINT) AS cached, CAST(sum(length(output_text)) AS BIGINT) AS output,
CAST(0 AS BIGINT) AS reasoning, CAST(sum(length(input_text) + length(output_text) + CASE WHEN ordinal % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS total FROM {RECS} GROUP BY 1""")
def token_usage(spark, sf_dir):
    """Calls of two kinds: one reports cached tokens and a total, the other neither."""
    c, n = F.col, F.length
    full = F.struct(n("input_text").alias("prompt_tokens"), n("output_text").alias("completion_tokens"), (n("input_text") + n("output_text") + 1).alias("total_tokens"), F.struct(c("ordinal").alias("cached_tokens")).alias("prompt_tokens_details"))
    short = F.struct(n("input_text").alias("input_tokens"), n("output_text").alias("output_tokens"))
    response = F.when(c("ordinal") % 2 == 0, F.to_json(F.struct(full.alias("usage")))).otherwise(F.to_json(F.struct(short.alias("usage"))))
    return answers.usage(recs(spark, sf_dir).select("mode", response.alias("response")), ["mode"])


# ---- messages and listings

AGENT = {"preamble": " You choose. ", "Rules": "Be short.", "Empty": " ", "Output": "JSON only."}
BINDINGS = [{"id": "task", "prompt_text": "Task:", "required": True}, {"id": "memory", "prompt_text": "Memory:"}, {"id": "mode"}, {"id": "secret", "visible_in_prompt": False}]
TARGETS = answers.targets_text([{"id": "lang", "label": "Language"}, {"id": "tags", "min_selected": 0, "max_selected": 2}, {"label": "no id"}], FIELDS, {"tags": "chosen"})


@query(f"""SELECT record_id, concat_ws(chr(10) || chr(10), 'You choose.', 'Memory:' || chr(10) || {TRIMMED["output_text"]}, '## Output' || chr(10) || 'JSON only.',
'## Decision Targets' || chr(10) || CASE WHEN tag = 'Gold' THEN 'any' ELSE {{t}} END, '## Rules' || chr(10) || 'Be short.', CASE WHEN tag = 'Gold' THEN '## Decision Targets' || chr(10) || {{t}} END) AS system,
'Task:' || chr(10) || {TRIMMED["input_text"]} || CASE WHEN mode = 'QA' THEN '' ELSE chr(10) || chr(10) || mode END AS user FROM {RECS}""".format(t="'" + TARGETS.replace("'", "''") + "'"))
def agent_messages(spark, sf_dir):
    """Memory goes to the system message, targets to their place, those of Gold records after their own text."""
    c = F.col
    payload = {"task": c("input_text"), "memory": c("output_text"), "mode": F.when(c("mode") != "QA", c("mode")), "secret": c("tag"), "decision_targets": F.when(c("tag") == "Gold", "any ")}
    system, user = prompt.agent_messages(AGENT, BINDINGS, payload, TARGETS, ["id:memory", "Output", "", "secret", "decision_targets", "unknown"])
    return recs(spark, sf_dir).select("record_id", system.alias("system"), user.alias("user"))


def _score(x: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.8f', round({x}, 6)), '0+$', ''), '\\.$', '')"


def _lines(head: str, id_: str, **fields: str) -> str:
    return f"{head} || ':** `' || {id_} || '`'" + "".join(f" || chr(10) || '- {k}: `' || {v} || '`'" for k, v in fields.items()) + " || chr(10) || chr(10)"


BODY = f"'INPUT' || chr(10) || '```text' || chr(10) || {STRIP.format('r.input_text')} || chr(10) || '```' || chr(10) || 'OUTPUT' || chr(10) || '```text' || chr(10) || {STRIP.format('r.output_text')} || chr(10) || '```'"
AGE = "pow(2, -{} / 10.0::DOUBLE)"
LISTED = f"""(SELECT file_id, 1 AS section, pos, {_lines("'**W' || pos || '. record_id'", "record_id", tag="tag", retrieval_source_mode="'working'")} || {BODY} AS text FROM {WORKING} r
UNION ALL SELECT file_id, 2, pos, {_lines("'**E' || pos || '. record_id'", "r.record_id", tag="t.tag", final_score=_score("final_score"), semantic_score=_score("semantic_score"), recency_score=_score(AGE.format("k")), episode_distance_k="k")} || {BODY}
FROM (SELECT record_id, tag, final_score, semantic_score, k, row_number() OVER (PARTITION BY file_id ORDER BY final_score DESC, record_id) AS pos FROM {TOP_FINAL}) t JOIN {RECS} r USING (record_id)
UNION ALL SELECT file_id, 3, pos, {_lines("'**M' || pos || '. vector_id'", "vector_id", record_id="r.record_id", role="role", final_score=_score("s"), semantic_score=_score("score"), recency_score=_score(AGE.format("k")), episode_distance_k="k")} || '```text' || chr(10) || CASE role WHEN 'question' THEN {STRIP.format("input_text")} ELSE {STRIP.format("output_text")} END || chr(10) || '```'
FROM (SELECT *, row_number() OVER (ORDER BY s DESC, vector_id) AS pos FROM (SELECT h.*, d.file_id, d.k, d.input_text, d.output_text, CASE WHEN d.tag = 'Gold' THEN h.score ELSE 0.9::DOUBLE * h.score + 0.1::DOUBLE * pow(2, -d.k / 10.0::DOUBLE) END AS s
FROM {HITS} h JOIN {DISTANCE} d USING (record_id) WHERE h.role IN ('question', 'answer') AND d.tag <> 'Black') QUALIFY pos <= 5) r
UNION ALL SELECT x.file_id, 4, row_number() OVER (ORDER BY recall_key), {_lines("'**record_id'", "r.record_id", file_id="x.file_id", tag="x.tag", direct_recall_key="recall_key")} || {BODY} FROM ({RECALL}) x JOIN {RECS} r USING (record_id))"""
NUMBERS = {"Working Memory Candidates": 1, "Episodic Candidates": 2, "Semantic Memory Chunks": 3, "Direct Recall Candidate": 4}


@query(f"SELECT file_id, '{render.CANDIDATES}'" + "".join(f" || chr(10) || chr(10) || '#### {s}' || chr(10) || coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (section = {NUMBERS.get(s, 0)}), '(none)')" for s in render.SECTIONS) + f" AS markdown FROM {LISTED} GROUP BY 1")
def render_candidates(spark, sf_dir):
    """Newest records, best parents, best chunks and recalled records of every file, listed with their scores."""
    c, own = F.col, recs(spark, sf_dir)
    texts = own.select("record_id", "input_text", "output_text")
    both = render.question_answer(c("input_text"), c("output_text"))
    name = lambda mark, what: F.concat(F.lit(mark), c("pos").cast("string"), F.lit(f". {what}"))
    six = lambda x: fn.format_score(F.round(x, 6))
    rated = lambda final, semantic: {"final_score": six(c(final)), "semantic_score": six(c(semantic)), "recency_score": six(vec.recency(c("k"))), "episode_distance_k": c("k")}
    best = top_parents(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("final_score"), "record_id")))
    chunks = memory.semantic_chunks(hits(spark, sf_dir), own).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("chunk_score"), "vector_id")))  # five rows
    recalled = mem_direct_recall(spark, sf_dir).withColumn("pos", F.row_number().over(Window.orderBy("recall_key")))  # a request's keys
    text = F.when(c("role") == "question", c("input_text")).otherwise(c("output_text"))
    entry = lambda rows, section, line: rows.select("file_id", F.lit(section).alias("section"), c("pos").cast("long").alias("pos"), line.alias("text"))
    made = (
        entry(memory.latest(own, 2), "Working Memory Candidates", render.candidate(name("W", "record_id"), c("record_id"), {"tag": c("tag"), "retrieval_source_mode": F.lit("working")}, both)),
        entry(best.join(texts, "record_id"), "Episodic Candidates", render.candidate(name("E", "record_id"), c("record_id"), {"tag": c("tag"), **rated("final_score", "semantic_score")}, both)),
        entry(chunks.join(texts, "record_id"), "Semantic Memory Chunks", render.candidate(name("M", "vector_id"), c("vector_id"), {"record_id": c("record_id"), "role": c("role"), **rated("chunk_score", "score")}, render.fenced(text))),
        entry(recalled.join(texts, "record_id"), "Direct Recall Candidate", render.candidate(F.lit("record_id"), c("record_id"), {"file_id": c("file_id"), "tag": c("tag"), "direct_recall_key": c("recall_key")}, both)),
    )
    return render.candidates_markdown(made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3]))
