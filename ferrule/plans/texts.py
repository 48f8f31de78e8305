"""Queries of text functions, gates, budgets and rendering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import schema
from ..functions import text as fn
from ..functions import vectors as vec
from ..operators import gate, memory, prompt, reduce, render
from ..operators.ingest import chunk_rows
from .ingest import STRIP
from .memory import RECS, recs
from .registry import query, table
from .retrieval import SPARSE_TOP, sparse_list

SPLIT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({}, '\n{{2,}}', chr(10), 'g'), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')"
SENTENCES = SPLIT.format("text")


def sentence_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.sentences(F.col("text")).alias("s"))


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s[1] AS first, s[-1] AS last FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def txt_sentences(spark, sf_dir):
    return sentence_rows(spark, sf_dir).select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"))


@query(f"""SELECT doc_id, i, array_to_string(list_slice(s, 2 * i + 1, 2 * i + 3), ' ') AS win FROM (SELECT doc_id, s, unnest(range(0, CASE WHEN len(s) = 0 THEN 0 WHEN len(s) <= 3 THEN 1 ELSE CAST(ceil((len(s) - 3) / 2.0) AS BIGINT) + 1 END)) AS i
FROM (SELECT doc_id, {SENTENCES} AS s FROM documents))""")
def txt_sentence_windows(spark, sf_dir):
    rows = sentence_rows(spark, sf_dir).select("doc_id", F.posexplode(fn.sentence_windows(F.col("s"))).alias("i", "win"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), "win")


@query(r"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n FROM conversations")
def txt_ws_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.word_count(F.col("text")).cast("long").alias("n"))


@query(r"SELECT conv_id, turn, CASE WHEN len(w) <= 12 THEN text ELSE array_to_string(list_slice(w, 1, 12), ' ') END AS head FROM (SELECT *, regexp_extract_all(text, '\S+') AS w FROM conversations)")
def txt_trunc_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.first_words(F.col("text"), 12).alias("head"))


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '[^\p{L}\p{N}\p{M}_\s]+', '', 'g') AS key FROM conversations")
def txt_norm_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.norm_key(F.col("text")).alias("key"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS phrase FROM conversations")
def txt_norm_phrase(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.norm_phrase(F.col("text")).alias("phrase"))


MASKED = r"regexp_replace(regexp_replace(regexp_replace({}, '(?m)^([ \t]*)### +(.*?)[ \t]*$', '\1[H3] \2', 'g'), '(?m)^([ \t]*)## +(.*?)[ \t]*$', '\1[H2] \2', 'g'), '(?m)^([ \t]*)# +(.*?)[ \t]*$', '\1[H1] \2', 'g')"
HEADED = "'# ' || source || chr(10) || '  ## ' || lang || '  ' || chr(10) || text || chr(10) || '### ' || n_chars || chr(10) || '#no heading'"


@query(f"SELECT doc_id, sha256({STRIP.format(MASKED.format(HEADED))}) AS sha FROM documents")
def txt_sanitize(spark, sf_dir):
    """Whole texts, with headings of three levels before and after them."""
    marked = F.concat(F.lit("# "), F.col("source"), F.lit("\n  ## "), F.col("lang"), F.lit("  \n"), F.col("text"), F.lit("\n### "), F.col("n_chars").cast("string"), F.lit("\n#no heading"))
    return table(spark, sf_dir, "documents").select("doc_id", fn.text_sha(fn.mask_headings(marked)).alias("sha"))


@query(r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), ''), 'Untitled') AS title FROM pages")
def txt_safe_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.safe_title(F.col("url")).alias("title"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def txt_escape_attr(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.escape_attr(F.col("html")).alias("escaped"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) END AS tokens FROM documents")
def txt_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("SELECT event_id, props AS plain, props AS wrapped, '{}' AS broken FROM events")
def txt_json_object(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    obj = lambda c: fn.json_object(c)
    return events.select("event_id", obj(F.col("props")).alias("plain"), obj(F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done"))).alias("wrapped"), obj(F.concat(F.lit("{"), F.col("event_type"))).alias("broken"))


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1")
def txt_distinct_ci(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.array(F.col("lang"), F.upper("lang"), F.lit(" ")).alias("items")).distinct()
    joined = docs.groupBy("source").agg(fn.distinct_ci(F.flatten(F.collect_list("items"))).alias("d"))
    return joined.select("source", F.array_join(F.array_sort(F.transform("d", F.lower)), ",").alias("langs"))


@query("SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'user' END AS role FROM conversations")
def txt_normalise_enum(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.normalise_one(F.col("role"), ["user", "assistant"], "user").alias("role"))


# ---- gates, classes, budgets


USEFUL = "CASE WHEN l.toxic = 1 THEN 'discarded' WHEN l.quality = 1 THEN 'useful' ELSE 'borderline' END"
GATED = f"(SELECT s.id, s.rank, coalesce({USEFUL}, 'borderline') AS label FROM ({SPARSE_TOP}) s LEFT JOIN labels l ON l.doc_id = s.id WHERE s.rank <= 30)"


def gated(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), gate.usefulness(F.col("quality"), F.col("toxic")).alias("label"))
    return gate.gate(sparse_list(spark, sf_dir), labels)


@query(f"SELECT id, rank, label FROM {GATED}")
def gate_label_join(spark, sf_dir):
    return gated(spark, sf_dir).select("id", "rank", "label")


@query(f"SELECT id, rank, CAST(row_number() OVER (ORDER BY rank) AS VARCHAR) AS local_id FROM {GATED} WHERE label = 'useful' ORDER BY rank LIMIT 12")
def gate_useful_topn(spark, sf_dir):
    return gate.useful(gated(spark, sf_dir)).select("id", "rank", "local_id")


CLASSES = [("ID1", "english text", "en", 1), ("ID2", "French text", "fr", 2), ("ID3", "german  text", "de", 3), ("ID9", "Spanish text", "es", 4)]


@query("""SELECT class_id, CAST(priority AS INT) AS priority, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE lang WHEN 'en' THEN 'ID1' WHEN 'fr' THEN 'ID2' WHEN 'de' THEN 'ID3' END AS class_id,
CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 END AS priority FROM documents) WHERE class_id IS NOT NULL GROUP BY 1, 2""")
def class_group(spark, sf_dir):
    """Documents answer with an id, an exact phrase or one that needs normalising; a class with an unknown id takes none."""
    classes = gate.active_classes(spark.createDataFrame(CLASSES, "class_id string, phrase string, context string, priority int"))
    answer = F.when(F.col("lang") == "en", "ID1").when(F.col("lang") == "fr", "French text").when(F.col("lang") == "de", "German text ").otherwise("Spanish text")
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), answer.alias("answer"))
    counts = gate.assign_class(items, classes).where("class_id IS NOT NULL").groupBy("class_id").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(classes.select("class_id", "priority")), "class_id").select("class_id", "priority", "n")


@query("""SELECT doc_id, CASE WHEN t < 1200 THEN 'tight' WHEN t < 1800 THEN 'narrow' WHEN t < 2600 THEN 'medium' ELSE 'broad' END AS tier, CAST(CASE WHEN t < 1200 THEN 1 WHEN t < 1800 THEN 2 WHEN t < 2600 THEN 3 END AS BIGINT) AS n_groups
FROM (SELECT doc_id, CASE WHEN n_chars % 4000 <= 0 THEN 3000 ELSE n_chars % 4000 END AS t FROM documents)""")
def budget_tiers(spark, sf_dir):
    tier, groups = gate.budget_tier(F.col("n_chars") % 4000)
    return table(spark, sf_dir, "documents").select("doc_id", tier.alias("tier"), groups.alias("n_groups"))


@query(f"""SELECT id, CASE WHEN l = 0 THEN 'SELECTED' ELSE 'DISCARDED' END AS status, CAST(CASE WHEN l = 0 THEN n - i + 1 ELSE 0 END AS BIGINT) AS score
FROM (SELECT id, l, row_number() OVER (ORDER BY l, rank) AS i, count(*) OVER () AS n FROM (SELECT id, min(l) AS l, min(rank) AS rank FROM (SELECT id, 0 AS l, rank FROM {GATED} WHERE rank % 3 = 0 UNION ALL SELECT id, 1, rank FROM {GATED} WHERE label = 'useful') GROUP BY 1))""")
def selected_order(spark, sf_dir):
    rows = gated(spark, sf_dir).withColumn("pos", F.col("rank"))
    return gate.selected_order(rows.where("rank % 3 = 0"), rows.where("label = 'useful'"))


@query(f"""SELECT record_id, least(CAST(round_even(500.0::DOUBLE * q / greatest(q + a, 1), 0) AS INT), 150) AS question_budget, 500 - least(CAST(round_even(500.0::DOUBLE * q / greatest(q + a, 1), 0) AS INT), 150) AS answer_budget
FROM (SELECT record_id, greatest(1, CAST(ceil(length(input_text) / 4.0) AS INT)) AS q, greatest(1, CAST(ceil(length(output_text) / 4.0) AS INT)) AS a FROM {RECS})""")
def qa_budget(spark, sf_dir):
    q, a = vec.qa_budget(fn.token_estimate(F.col("input_text")), fn.token_estimate(F.col("output_text")), 500, 150)
    return recs(spark, sf_dir).select("record_id", q.alias("question_budget"), a.alias("answer_budget"))


@query("""SELECT materiality, relation, (materiality = 'WEAK' AND relation IN ('SAME_TOPIC', 'RELATED_DOMAIN')) AS brief_for_retrieval, relation <> 'IRRELEVANT' AS memory_allowed, count(*) AS n
FROM (SELECT CASE WHEN n_chars >= 1500 THEN 'STRONG' ELSE 'WEAK' END AS materiality, CASE lang WHEN 'en' THEN 'SAME_TOPIC' WHEN 'fr' THEN 'RELATED_DOMAIN' ELSE 'IRRELEVANT' END AS relation FROM documents) GROUP BY 1, 2, 3, 4""")
def relation_decisions(spark, sf_dir):
    relation = F.when(F.col("lang") == "en", "SAME_TOPIC").when(F.col("lang") == "fr", "RELATED_DOMAIN").otherwise("IRRELEVANT")
    states = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") >= 1500, "STRONG").otherwise("WEAK").alias("materiality"), relation.alias("relation"))
    return gate.decide(states.groupBy("materiality", "relation").agg(F.count("*").alias("n"))).select("materiality", "relation", "brief_for_retrieval", "memory_allowed", "n")


def _vectors(column: str) -> str:
    """SQL: counts of hashed words of each window of three sentences, two apart."""
    windows = f"(SELECT list_transform(range(0, CASE WHEN len(s) = 0 THEN 0 WHEN len(s) <= 3 THEN 1 ELSE CAST(ceil((len(s) - 3) / 2.0) AS BIGINT) + 1 END), lambda i: array_to_string(list_slice(s, 2 * i + 1, 2 * i + 3), ' ')) FROM (SELECT {SPLIT.format(f"coalesce({column}, '')")} AS s))"
    buckets = f"list_transform({windows}, lambda t: list_transform(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64))"
    return f"list_transform({buckets}, lambda b: list_transform(range(0, 64), lambda d: CAST(len(list_filter(b, lambda x: x = d)) AS DOUBLE)))"


CENTRE = "CASE WHEN len({v}) > 0 THEN list_transform(range(1, 65), lambda d: coalesce(list_avg(list_transform({v}, lambda x: x[d])), 0)) END"
TOP_MEAN = "list_avg(list_slice(list_reverse_sort({s}), 1, CASE WHEN len({s}) <= 4 THEN len({s}) WHEN len({s}) <= 20 THEN 4 ELSE len({s}) // 5 END))"
SCORED = f"""(SELECT *, {TOP_MEAN.format(s="bs")} AS brief_mean, {TOP_MEAN.format(s="ps")} AS pending_mean FROM (
SELECT *, CASE WHEN c IS NOT NULL THEN list_transform(own, lambda x: coalesce(list_sum(list_transform(range(1, 65), lambda i: x[i] * c[i])) / nullif(sqrt(list_sum(list_transform(range(1, 65), lambda i: x[i] * x[i]))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: c[i] * c[i]))), 0), 0)) END AS bs,
CASE WHEN p IS NOT NULL THEN list_transform(own, lambda x: coalesce(list_sum(list_transform(range(1, 65), lambda i: x[i] * p[i])) / nullif(sqrt(list_sum(list_transform(range(1, 65), lambda i: x[i] * x[i]))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: p[i] * p[i]))), 0), 0)) END AS ps
FROM (SELECT record_id, brief, own, {CENTRE.format(v="bv")} AS c, {CENTRE.format(v="pv")} AS p FROM (
SELECT record_id, brief, list_concat({_vectors("input_text")}, {_vectors("output_text")}) AS own, {_vectors("brief")} AS bv, {_vectors("pending")} AS pv
FROM (SELECT *, lag(output_text) OVER w AS brief, lag(input_text, 2) OVER w AS pending FROM {RECS} WINDOW w AS (PARTITION BY file_id ORDER BY ordinal))))))"""


def scored(spark, sf_dir):
    """A record's brief is the answer before it; what is pending, the question before that."""
    order = Window.partitionBy("file_id").orderBy("ordinal")
    rows = recs(spark, sf_dir).withColumns({"brief": F.lag("output_text").over(order), "pending": F.lag("input_text", 2).over(order)})
    return gate.brief_scores(rows)


@query(f"SELECT record_id, CAST(len(own) AS INT) AS n_vectors, round(brief_mean, 6) AS brief_mean, round(pending_mean, 6) AS pending_mean FROM {SCORED}")
def brief_gate_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("record_id", "n_vectors", F.round("brief_mean", 6).alias("brief_mean"), F.round("pending_mean", 6).alias("pending_mean"))


LEAST = 0.7  # hashed counts of words are more alike than a learned encoder's vectors


@query(f"""SELECT record_id, CASE WHEN brief IS NULL THEN 'init_no_previous_activebrief' WHEN len(own) = 0 THEN 'skip_no_qa_vectors' WHEN c IS NULL THEN 'activebrief_safe_pass' WHEN brief_mean >= {LEAST} THEN 'activebrief_update'
WHEN pending_mean >= {LEAST} THEN 'pending_topic_shift' ELSE 'skip_and_update_pending_topic' END AS route FROM {SCORED}""")
def brief_gate_route(spark, sf_dir):
    rows = scored(spark, sf_dir)
    route = gate.route(F.col("brief").isNotNull(), F.col("n_vectors"), F.col("has_centre"), F.col("brief_mean"), F.col("pending_mean"), LEAST)
    return rows.select("record_id", route.alias("route"))


@query(f"""SELECT request_id, reason, slot, record_id, pos FROM (SELECT conv_id AS request_id, CASE WHEN conv_id % 4 = 1 THEN 'no_active_file' WHEN conv_id % 4 = 2 THEN 'empty_query' END AS reason, conv_id FROM (SELECT DISTINCT conv_id FROM conversations))
LEFT JOIN (SELECT file_id, 'working' AS slot, record_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ordinal DESC, record_id DESC) AS pos FROM {RECS} WHERE tag <> 'Black') WHERE pos <= 2) ON reason IS NULL AND file_id = conv_id
WHERE reason IS NOT NULL OR slot IS NOT NULL""")
def empty_pack(spark, sf_dir):
    """A request per conversation: some have no active file, some ask nothing; these get a reason, the others their newest records."""
    c = F.col("conv_id")
    asked = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    requests = asked.select(c.alias("request_id"), F.when(c % 4 != 1, c).alias("file_id"), F.when(c % 4 == 2, " \n").otherwise("a question").alias("query"))
    working = memory.latest(recs(spark, sf_dir), 2)
    return memory.pack_or_reason(requests, memory.context_pack(working, working.limit(0), working.limit(0), working.limit(0)))


@query(f"SELECT id, 'DISCARDED' AS status, CAST(0 AS BIGINT) AS score, 'a3_selected_zero_useful_chunks' AS reason FROM {GATED} WHERE label <> 'useful'")
def empty_selection(spark, sf_dir):
    """A gate that lets nothing through: every candidate that isn't useful, alone."""
    return gate.empty_selection(gated(spark, sf_dir).where("label <> 'useful'"))


# ---- rendering


@query(f"""SELECT '<retrieved_chunks>' || chr(10) || string_agg('  <chunk index="' || rank || '" chunk_id="' || d.doc_id || '" source="' || d.source || '" info="Rt=' || regexp_replace(regexp_replace(printf('%.8f', round(s.score, 6)), '0+$', ''), '\\.$', '') || '">' || chr(10)
|| '    <chunk_text>' || chr(10) || '      ' || replace(trim(d.text, ' ' || chr(10)), chr(10), chr(10) || '      ') || chr(10) || '    </chunk_text>' || chr(10) || '  </chunk>', chr(10) ORDER BY rank) || chr(10) || '</retrieved_chunks>' AS xml
FROM ({SPARSE_TOP}) s JOIN documents d ON d.doc_id = s.id WHERE s.rank <= 10""")
def render_chunks_xml(spark, sf_dir):
    best = sparse_list(spark, sf_dir, 10)
    docs = table(spark, sf_dir, "documents").join(F.broadcast(best), F.col("doc_id") == F.col("id"))
    return render.chunks_xml(docs.select(F.col("rank").alias("pos"), F.col("doc_id").cast("string").alias("chunk_id"), "source", render.score_info(Rt=F.col("score")).alias("info"), F.col("text")))


@query(f"""SELECT file_id, string_agg('### Episode ' || pos || chr(10) || 'record_id: ' || record_id || chr(10) || 'tag: ' || tag || chr(10) || 'QUESTION:' || chr(10) || trim(input_text, ' ' || chr(10)) || chr(10) || 'ANSWER:' || chr(10) || trim(output_text, ' ' || chr(10)), chr(10) || chr(10) ORDER BY pos) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ordinal DESC, record_id DESC) AS pos FROM {RECS} WHERE tag <> 'Black' QUALIFY pos <= 2) GROUP BY 1""")
def render_memory_evidence(spark, sf_dir):
    return render.episodes_text(memory.latest(recs(spark, sf_dir), 2))


@query(f"""SELECT record_id, '# System' || chr(10) || 'tag ' || tag || chr(10) || chr(10) || '# Request' || chr(10) || {STRIP.format('input_text')} || CASE WHEN mode = 'QA' THEN '' ELSE chr(10) || chr(10) || '# Context' || chr(10) || {STRIP.format('output_text')} END
|| CASE WHEN tag = 'Gold' THEN chr(10) || chr(10) || '# Attachments' || chr(10) || record_id || '.txt' ELSE '' END AS prompt FROM {RECS}""")
def prompt_ready(spark, sf_dir):
    """Prompts with a context unless the record's mode is both, and with an attachment if it is Gold."""
    c = F.col
    context, attached = F.when(c("mode") != "QA", c("output_text")), F.when(c("tag") == "Gold", F.concat("record_id", F.lit(".txt "))).otherwise(" ")
    return recs(spark, sf_dir).select("record_id", render.prompt_ready(F.concat(F.lit("tag "), c("tag")), c("input_text"), context, attached).alias("prompt"))


@query(f"""SELECT record_id, CASE WHEN ordinal % 3 = 1 THEN '' ELSE '## TASK' || chr(10) || trim(input_text, ' ' || chr(10)) || chr(10) || chr(10) || '## CONTEXT' || chr(10) || tag || CASE WHEN ordinal % 3 = 2 THEN chr(10) || chr(10) || '## PREVIOUS MEMORY TITLE' || chr(10) || 'title' ELSE '' END END AS query FROM {RECS}""")
def query_text(spark, sf_dir):
    o, none = F.col("ordinal"), F.lit("")
    relation = F.when(o % 3 == 1, "IRRELEVANT").when(o % 3 == 2, "RELATED_DOMAIN").otherwise("SAME_TOPIC")
    return recs(spark, sf_dir).select("record_id", prompt.query_text(F.col("input_text"), none, F.col("tag"), F.lit("WEAK"), relation, none, F.lit("title")).alias("query"))


@query(f"""SELECT record_id, name, body FROM (SELECT record_id, unnest(['task', 'context', 'system', 'audience', 'purpose', 'tone', 'constraints', 'output_format']) AS name,
unnest(['Do ' || tag, mode, 'consultant', 'general audience', 'inform', 'neutral', 'be accurate and cite sources', 'free_text']) AS body FROM {RECS})""")
def preprocess_prompts(spark, sf_dir):
    """Headings by other and German names; sections with unknown names are left out, missing ones get defaults."""
    text = F.concat(F.lit("ignored\n# Aufgabe\nDo "), F.col("tag"), F.lit("\n## Background\n"), F.col("mode"), F.lit("\n### Odd one\nx"))
    prompts = recs(spark, sf_dir).select("record_id", text.alias("text"))
    return prompt.preprocess(prompts, schema.names(spark), schema.must_defaults(), key="record_id").where("name NOT IN ('role', 'depth', 'format', 'text')")


@query(f"""SELECT record_id, unnest(['task', 'context', 'tone']) AS name, unnest([CASE WHEN ordinal % 2 = 0 THEN 'last ' || mode ELSE tag END, CASE WHEN ordinal % 2 = 0 THEN tag ELSE '' END, 'dry']) AS body FROM {RECS}""")
def preprocess_repeats(spark, sf_dir):
    """Prompts whose headings repeat, under several names, in other cases and compatible forms: the last counts; one without a task takes its context for it."""
    c, prompts = F.col, recs(spark, sf_dir)
    twice = F.concat(F.lit("# Task\nfirst\n## Kontext \n"), c("tag"), F.lit("\n# TONE:\nwarm\n### Wishes\nlast "), c("mode"), F.lit("\n## Voice\ndry"))
    bare = F.concat(F.lit("before\r\n## Ｎｏｔｅｓ\r\n"), c("tag"), F.lit("\n# Style!\ndry\n#### not a section\n"))
    texts = prompts.select("record_id", F.when(c("ordinal") % 2 == 0, twice).otherwise(bare).alias("text"))
    made = prompt.preprocess(texts, schema.names(spark), {}, key="record_id").where("name IN ('task', 'context', 'tone')")
    every = prompts.select("record_id", F.explode(F.array(*map(F.lit, ("task", "context", "tone")))).alias("name"))
    return every.join(made, ["record_id", "name"], "left").select("record_id", "name", F.coalesce(F.substring_index("body", "\n####", 1), F.lit("")).alias("body"))


STATE = "CASE ordinal % 2 WHEN 0 THEN 'STRONG' ELSE 'WEAK' END AS m, CASE ordinal % 3 WHEN 0 THEN 'SAME_TOPIC' WHEN 1 THEN 'RELATED_DOMAIN' ELSE 'IRRELEVANT' END AS r"
TRIMMED = {c: STRIP.format(c) for c in ("input_text", "output_text", "tag", "mode")}
FULL = "(m = 'STRONG' AND r <> 'IRRELEVANT' OR m = 'WEAK' AND r <> 'RELATED_DOMAIN')"


def states(spark, sf_dir):
    """Records with all six pairs of materiality and relation."""
    o = F.col("ordinal")
    relation = F.when(o % 3 == 0, "SAME_TOPIC").when(o % 3 == 1, "RELATED_DOMAIN").otherwise("IRRELEVANT")
    return recs(spark, sf_dir).withColumns({"m": F.when(o % 2 == 0, "STRONG").otherwise("WEAK"), "r": relation})


@query(f"""SELECT record_id, '<user_prompt_under_evaluation>' || chr(10) || 'TASK:' || chr(10) || {TRIMMED["input_text"]} || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || tag || chr(10) || chr(10)
|| CASE WHEN {FULL} THEN 'PREVIOUS MEMORY SUMMARY:' || chr(10) || {TRIMMED["output_text"]} ELSE 'PREVIOUS MEMORY TITLE:' || chr(10) || mode END || chr(10) || chr(10) || '</user_prompt_under_evaluation>' AS prompt FROM (SELECT *, {STATE} FROM {RECS})""")
def comparison_prompt(spark, sf_dir):
    c = F.col
    return states(spark, sf_dir).select("record_id", prompt.comparison_prompt(c("input_text"), F.lit(" "), c("tag"), c("m"), c("r"), c("output_text"), c("mode")).alias("prompt"))


def _under(head: tuple[str, str]) -> str:
    return "'" + head[0] + "' || chr(10) || '" + head[1] + "' || chr(10) || chr(10)"


@query(f"""SELECT record_id, {_under(prompt.SUPPORT)} || CASE WHEN {FULL} THEN {_under(prompt.SUMMARY)} || 'Title: ' || mode || chr(10) || chr(10) || {TRIMMED["output_text"]} ELSE {_under(prompt.TOPIC)} || 'Title: ' || mode END || chr(10) || chr(10)
|| {_under(prompt.MEMORY)} || tag || CASE WHEN ordinal % 4 = 1 THEN '' ELSE chr(10) || chr(10) || {_under(prompt.RAW)} || {TRIMMED["input_text"]} END AS context FROM (SELECT *, {STATE} FROM {RECS})""")
def context_block(spark, sf_dir):
    """Whole brief or its title, memory, and raw evidence unless the stage hides it."""
    c, stage = F.col, F.when(F.col("ordinal") % 4 == 1, "a4").otherwise("a3")
    return states(spark, sf_dir).select("record_id", prompt.context_block(c("m"), c("r"), c("mode"), c("output_text"), c("tag"), F.lit(None).cast("string"), c("input_text"), stage).alias("context"))


@query(f"SELECT record_id, '[Pending skipped Q/A question]' || chr(10) || {STRIP.format('before')} || chr(10) || chr(10) || '[Current Q/A question]' || chr(10) || {TRIMMED['input_text']} AS text FROM (SELECT *, lag(input_text) OVER (PARTITION BY file_id ORDER BY ordinal) AS before FROM {RECS}) WHERE before IS NOT NULL")
def topic_shift(spark, sf_dir):
    """The question of the record before, as the pending one, and a record's own."""
    before = F.lag("input_text").over(Window.partitionBy("file_id").orderBy("ordinal"))
    rows = recs(spark, sf_dir).withColumn("before", before).where("before IS NOT NULL")
    return rows.select("record_id", prompt.topic_shift(F.col("before"), F.col("input_text"), "question").alias("text"))


OPTIONS = [("tone", "QA", "Question and answer"), ("tone", "Q", "Question"), ("audience", "Gold", "Experts")]


@query(f"""SELECT record_id, 'tone' AS field, CASE mode WHEN 'QA' THEN 'Question and answer' WHEN 'Q' THEN 'Question' ELSE mode END AS text FROM {RECS}
UNION ALL SELECT record_id, 'audience', CASE tag WHEN 'Gold' THEN 'Experts' ELSE tag END || ', other' FROM {RECS}""")
def option_labels(spark, sf_dir):
    """One option of a field, two of another; ids without a label stand for themselves."""
    item = lambda field, pos, c: F.struct(F.lit(field).alias("field"), F.lit(pos).alias("pos"), c.alias("id"))
    listed = F.array(item("tone", 0, F.concat(F.lit(" "), F.col("mode"))), item("audience", 0, F.col("tag")), item("audience", 1, F.lit("other")), item("audience", 2, F.lit(" ")))
    chosen = recs(spark, sf_dir).select("record_id", F.explode(listed).alias("x")).select("record_id", "x.*")
    return prompt.option_labels(chosen, spark.createDataFrame(OPTIONS, "field string, id string, label string"), "record_id")


@query(f"""SELECT '<evidence_chunks>' || chr(10) || string_agg('  <chunk index="' || rank || '" chunk_id="' || rank || '" rank="' || rank || '">' || chr(10) || '    <chunk_text>' || chr(10) || '      ' || replace({STRIP.format("d.text")}, chr(10), chr(10) || '      ') || chr(10) || '    </chunk_text>' || chr(10) || '  </chunk>', chr(10) ORDER BY rank) || chr(10) || '</evidence_chunks>' AS xml
FROM ({SPARSE_TOP}) s JOIN documents d ON d.doc_id = s.id WHERE s.rank <= 10""")
def render_evidence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(F.broadcast(sparse_list(spark, sf_dir, 10)), F.col("doc_id") == F.col("id"))
    return render.evidence_xml(docs.select(F.col("rank").alias("pos"), "text"))


@query(f"SELECT record_id, array_to_string(list_slice(list_transform(list_sort(list_transform(map_entries(list_histogram), lambda e: {{'n': -CAST(e.value AS INT), 'w': e.key}})), lambda x: x.w), 1, 5), ',') AS keywords FROM (SELECT record_id, histogram(word) AS list_histogram FROM (SELECT record_id, unnest(regexp_extract_all(lower(output_text), '\\p{{L}}{{3,}}')) AS word FROM {RECS}) GROUP BY 1)")
def auto_keywords(spark, sf_dir):
    return recs(spark, sf_dir).select("record_id", F.array_join(fn.auto_keywords(F.col("output_text")), ",").alias("keywords")).where("keywords <> ''")


@query(f"SELECT record_id, sha256('{{\"file_id\":' || file_id || ',\"input_hash\":\"' || sha256(input_text) || '\",\"record_id\":\"' || record_id || '\",\"tag\":\"' || tag || '\",\"user_keywords\":[]}}') AS sha FROM {RECS}")
def ingest_hash(spark, sf_dir):
    c = F.col
    payload = fn.canonical_sha(record_id=c("record_id"), file_id=c("file_id"), tag=c("tag"), input_hash=fn.text_sha(c("input_text")), user_keywords=F.array().cast("array<string>"))
    return recs(spark, sf_dir).select("record_id", payload.alias("sha"))


# ---- training data of the prompt shaper


@query(f"SELECT record_id FROM {RECS} QUALIFY row_number() OVER (PARTITION BY sha256(lower(trim(input_text)) || chr(31) || lower(trim(output_text))) ORDER BY record_id) = 1")
def train_canon_dedup(spark, sf_dir):
    from ..operators.ingest import first_by_fingerprint

    rows = recs(spark, sf_dir).select("record_id", F.lower(F.trim("input_text")).alias("q"), F.lower(F.trim("output_text")).alias("a"))
    return first_by_fingerprint(rows, F.col("q"), F.col("a"), order="record_id").select("record_id")


@query(f"SELECT record_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM (SELECT record_id, ('0x' || substr(md5(record_id), 1, 8))::BIGINT % 100 AS b FROM {RECS})")
def train_split(spark, sf_dir):
    bucket = F.conv(F.substring(F.md5("record_id"), 1, 8), 16, 10).cast("long") % 100
    return recs(spark, sf_dir).select("record_id", F.when(bucket < 80, "train").when(bucket < 90, "validation").otherwise("test").alias("split"))


@query(rf"""SELECT record_id, array_to_string(list_slice(w, s + 1, s + 16), ' ') AS win FROM (SELECT record_id, w, unnest(list_distinct(list_concat(range(0, greatest(len(w) - 16, 0) + 1, 8), [greatest(len(w) - 16, 0)]))) AS s
FROM (SELECT record_id, regexp_extract_all(input_text, '\S+') AS w FROM {RECS}) WHERE len(w) > 0)""")
def train_windows(spark, sf_dir):
    return recs(spark, sf_dir).select("record_id", F.explode(fn.token_windows(F.col("input_text"), 16)).alias("win"))


# ---- order-dependent reducers; tests compare those without SQL with plain versions


@query()
def mem_blocks(spark, sf_dir):
    rows = reduce.memory_entries(recs(spark, sf_dir))
    return rows.select("vector_id", "record_id", "role", "block", fn.text_sha(F.col("text")).alias("sha"))


FRAMED = "'---' || chr(10) || 'x: ' || lang || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '...' WHEN doc_id % 3 = 1 THEN '---' ELSE 'open' END || chr(10) || 'TAGS : a' || chr(10) || text || chr(10) || chr(10) || ' ' || chr(10) || '```py' || chr(10) || '@@META' || chr(10) || '## END_OF_PROMPT' || chr(10) || 'kept titles: b'"
LINES = f"list_transform(string_split({STRIP.format('t')}, chr(10)), lambda x: {STRIP.format('x')})"
BODY = "CASE WHEN doc_id % 4 = 0 THEN l WHEN coalesce(list_position(list_transform(l[2:], lambda x: x IN ('---', '...')), true), 0) = 0 THEN [] ELSE l[list_position(list_transform(l[2:], lambda x: x IN ('---', '...')), true) + 2:] END"
NOISE = "starts_with(x, '```') OR starts_with(lower(x), '@@meta') OR x IN ('END_OF_PROMPT', '## END_OF_PROMPT', '### END_OF_PROMPT') OR regexp_matches(x, '(?i)^(title|author|version|updated|tags|date|created|modified|description)\\s*:')"


@query(f"""SELECT doc_id, sha256({STRIP.format("regexp_replace(array_to_string(list_filter(b, lambda x: NOT (" + NOISE + ")), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS sha
FROM (SELECT doc_id, {BODY} AS b FROM (SELECT doc_id, {LINES} AS l FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'first' || chr(10) ELSE '' END || {FRAMED} AS t FROM documents)))""")
def clean_chunk(spark, sf_dir):
    """Whole texts after front matter that is closed, open, or not at the start, and before marks and fences."""
    n = F.col("doc_id")
    close = F.when(n % 3 == 0, "...").when(n % 3 == 1, "---").otherwise("open")
    framed = F.concat(F.when(n % 4 == 0, "first\n").otherwise(""), F.lit("---\nx: "), F.col("lang"), F.lit("\n"), close, F.lit("\nTAGS : a\n"), F.col("text"), F.lit("\n\n \n```py\n@@META\n## END_OF_PROMPT\nkept titles: b"))
    return table(spark, sf_dir, "documents").select("doc_id", fn.text_sha(reduce.clean_chunk(framed)).alias("sha"))


@query(f"""SELECT doc_id, array_to_string(list_reduce(list_concat([{{'used': 0::BIGINT, 'kept': []::VARCHAR[]}}], list_transform(s, lambda x: {{'used': greatest(1, CAST(ceil(length(x) / 4.0) AS BIGINT)), 'kept': [x]}})),
lambda acc, x: CASE WHEN acc.used + x.used > 120 THEN acc ELSE {{'used': acc.used + x.used, 'kept': list_concat(acc.kept, x.kept)}} END).kept, ' ') AS kept FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)""")
def greedy_budget(spark, sf_dir):
    return sentence_rows(spark, sf_dir).select("doc_id", F.array_join(reduce.keep_within(F.col("s"), 120), " ").alias("kept"))


@query()
def reduce_mmr(spark, sf_dir):
    """Documents cut to 200 tokens: windows of sentences by counts of hashed words, nearest to the document's mean."""
    rows = sentence_rows(spark, sf_dir).where(F.size("s") > 0)
    made = rows.select("doc_id", F.col("s").alias("sentences"), fn.window_places(F.col("s")).alias("windows"), vec.word_vectors(fn.sentence_windows(F.col("s")), 32).alias("vectors"))
    return reduce.reduce_records(made.withColumn("anchor", vec.centroid(F.col("vectors"), 32)), 200, "doc_id")


@query()
def mem_reduce(spark, sf_dir):
    """Questions and answers cut to 60 tokens together, at most 20 of them for the question."""
    return reduce.reduce_pairs(recs(spark, sf_dir), 60, 20)
