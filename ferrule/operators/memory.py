"""Conversational memory: records, hits and their parents, tags, recency, and the context pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, clean_mode, strip
from ..functions.vectors import chunk_score, distance_score, episodic_score, mode_weighted
from .predicates import without_tags

TAG_ORDER = {"Gold": 0, "Green": 1}


def pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: user turns that an assistant turn follows at once."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumns({"next_role": F.lead("role").over(after), "answer": F.lead("text").over(after)})
    return both.where("role = 'user' AND next_role = 'assistant'").where(~blank(F.col("answer"))).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def records(turns: DataFrame) -> DataFrame:
    """Memory records of conversations; tag by the turn's last digit, mode by its remainder of three."""
    tag = F.when(F.col("turn") % 10 == 0, "Gold").when(F.col("turn") % 10 == 7, "Black").otherwise("Green")
    mode = F.when(F.col("turn") % 3 == 0, "QA").when(F.col("turn") % 3 == 1, "Q").otherwise("A")
    return pairs(turns).select(
        F.col("conv_id").alias("file_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"),
        F.col("turn").alias("ordinal"),
        F.col("question").alias("input_text"),
        F.col("answer").alias("output_text"),
        tag.alias("tag"),
        mode.alias("mode"),
    )


def latest(recs: DataFrame, n: int, tags: tuple[str, ...] | None = None) -> DataFrame:
    """Per file the newest n records that aren't excluded, of the given tags if any; ties by record_id."""
    own = recs.where(F.col("tag").isin(*tags)) if tags else without_tags(recs)
    order = Window.partitionBy("file_id").orderBy(F.desc("ordinal"), F.desc("record_id"))
    return own.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= n)


def tag_rank(tag: Column) -> Column:
    return F.when(tag == "Gold", 0).when(tag == "Green", 1).otherwise(2)


def direct_recall(recs: DataFrame, keys: DataFrame, key: str = "recall_key") -> DataFrame:
    """Per key one record over all files: Gold, then Green, then others, then the newest. Merged before the shuffle."""
    found = without_tags(recs).join(keys.select(key).distinct(), key)
    best = F.min_by(F.struct("record_id", "file_id", "tag", "ordinal"), F.struct(tag_rank(F.col("tag")), -F.col("ordinal"), F.col("record_id")))
    return found.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def episode_distance(recs: DataFrame) -> DataFrame:
    """k: records of the file after this one (0 the newest); idx and total."""
    back = Window.partitionBy("file_id").orderBy(F.desc("ordinal"), F.desc("record_id"))
    total = F.count("*").over(Window.partitionBy("file_id"))
    k = F.row_number().over(back) - 1
    return recs.withColumns({"k": k.cast("long"), "total": total}).withColumn("idx", (F.col("total") - 1 - F.col("k")).cast("long"))


def scored_hits(hits: DataFrame) -> DataFrame:
    """score, or what the distance gives where it is null, and the rank by it."""
    scored = hits.withColumn("score", F.coalesce(F.col("score"), distance_score(F.col("distance"))))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id")).cast("long"))


def parent_scores(hits: DataFrame) -> DataFrame:
    """record_id, best score by role (any role but question and answer is meta), hit_count; blank records dropped."""
    best = lambda cond, name: F.max(F.when(cond, F.col("score"))).alias(name)
    role = F.col("role")
    other = ~F.coalesce(role.isin("question", "answer"), F.lit(False))
    return hits.where(~blank(F.col("record_id"))).groupBy("record_id").agg(best(role == "question", "question_score"), best(role == "answer", "answer_score"), best(other, "meta_score"), F.count("*").alias("hit_count"))


def parents(hits: DataFrame, recs: DataFrame) -> DataFrame:
    """Parents with the mode's weighted score, blended with recency unless Gold; excluded tags dropped."""
    aged = episode_distance(recs).select("record_id", "file_id", "tag", "mode", "k")
    joined = without_tags(parent_scores(hits).join(aged, "record_id"))
    semantic = mode_weighted(F.col("mode"), F.col("answer_score"), F.col("question_score"), F.col("meta_score"))
    return joined.withColumn("semantic_score", semantic).withColumn("final_score", episodic_score(F.col("semantic_score"), F.col("k"), F.col("tag")))


def semantic_chunks(hits: DataFrame, recs: DataFrame, n: int = 5) -> DataFrame:
    """The best n question and answer hits, live metadata first, blended with recency unless Gold."""
    live = episode_distance(recs).select("record_id", "file_id", "tag", "k")
    joined = without_tags(hits.where(F.col("role").isin("question", "answer")).join(live, "record_id"))
    final = joined.withColumn("chunk_score", chunk_score(F.col("score"), F.col("k"), F.col("tag")))
    return final.orderBy(F.desc("chunk_score"), "vector_id").limit(n)


def gold_union(gold: DataFrame, semantic: DataFrame, cap: int = 3) -> DataFrame:
    """Per file Gold records, then semantic ones by score, each record once, at most ``cap``; source says which."""
    both = gold.select("file_id", "record_id", F.lit("gold").alias("source"), F.lit(0).alias("priority"), F.lit(None).cast("double").alias("score")).unionByName(
        semantic.select("file_id", "record_id", F.lit("semantic").alias("source"), F.lit(1).alias("priority"), F.col("final_score").alias("score"))
    )
    once = both.groupBy("file_id", "record_id").agg(F.min(F.struct("priority", (-F.coalesce("score", F.lit(0.0))).alias("minus"), "source")).alias("m"))
    order = Window.partitionBy("file_id").orderBy("m.priority", "m.minus", "record_id")
    return once.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= cap).select("file_id", "record_id", F.col("m.source").alias("source"), "pos")


def context_pack(working: DataFrame, episodic: DataFrame, chunks: DataFrame, recall: DataFrame) -> DataFrame:
    """One table of all slots: slot, file_id, record_id, pos."""
    slot = lambda df, name: df.select(F.lit(name).alias("slot"), F.col("file_id"), F.col("record_id"), (F.col("pos") if "pos" in df.columns else F.lit(1)).cast("long").alias("pos"))
    return slot(working, "working").unionByName(slot(episodic, "episodic")).unionByName(slot(chunks, "semantic_chunk")).unionByName(slot(recall, "direct_recall"))


def empty_pack(working: DataFrame, reason: str) -> DataFrame:
    """No active file or an empty query: no rows, and the reason as a column of the schema."""
    return context_pack(working, working, working, working).limit(0).withColumn("reason", F.lit(reason))


def metainfo(recs: DataFrame) -> DataFrame:
    """Per file: records, their ids in order, the first and the last ordinal, tags."""
    return recs.groupBy("file_id").agg(
        F.count("*").alias("n_records"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "record_id"))), lambda x: x["record_id"]), ",").alias("record_ids"),
        F.min("ordinal").alias("created"),
        F.max("ordinal").alias("updated"),
        F.countDistinct("tag").alias("n_tags"),
    )


def keyword_union(rows: DataFrame, key: str, order: str, keywords: str = "keywords") -> DataFrame:
    """Per key all keywords in order, each once whatever its case, as first written. Repeats are merged before they are gathered."""
    listed = rows.select(key, order, F.posexplode(keywords).alias("i_", "word_")).withColumn("word_", strip(F.col("word_"))).where(F.col("word_") != "")
    first = listed.groupBy(key, F.lower("word_").alias("lower_")).agg(F.min(F.struct(order, "i_", "word_")).alias("first_"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("first_")), lambda x: x["word_"]).alias(keywords))


def contributors(before: Column, own: Column) -> Column:
    """Ids of records that a brief comes from: those of the brief before, then the new ones, each once; blank ones dropped."""
    return F.array_distinct(F.filter(F.concat(F.coalesce(before, F.array()), F.coalesce(own, F.array())), lambda x: ~blank(x)))


def overlay(log: DataFrame, edits: DataFrame, fields: list[str], key: str = "record_id") -> DataFrame:
    """Fields of edits where they are there; blank tags don't overwrite. Unknown records are ignored."""
    new = edits.select(key, *(F.col(f).alias(f"{f}_new") for f in fields))
    joined = log.join(new, key, "left")
    usable = lambda f: F.when(~blank(F.col("tag_new")), F.col("tag_new")) if f == "tag" else F.col(f"{f}_new")
    out = {f: F.coalesce(usable(f), F.col(f)) for f in fields}
    changed = ~F.struct(*(out[f] for f in fields)).eqNullSafe(F.struct(*(F.col(f) for f in fields)))
    return joined.select(*(F.col(c) for c in log.columns if c not in fields), *(out[f].alias(f) for f in fields), changed.alias("changed"))


# Tags that a record may have.
TAGS = ("Gold", "Green", "Black")


def sync_edits(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Records (record_id, tag, user_keywords, retrieval_source_mode, direct_recall_key and others) after edits of these fields, and ``changed``.

    Edits of records that aren't there, blank ids included, do nothing. An unknown tag and null keywords leave what is
    there; a mode that isn't one of the three becomes QA; a recall key is stripped, null is an empty one.
    """
    tag, own = strip(F.col("tag")), F.trim(F.col("record_id"))
    new = edits.select(own.alias("record_id"), F.when(tag.isin(*TAGS), tag).alias("tag_"), F.col("user_keywords").alias("words_"), clean_mode(F.col("retrieval_source_mode")).alias("mode_"), F.coalesce(strip(F.col("direct_recall_key")), F.lit("")).alias("key_"), F.lit(True).alias("edited_"))
    joined = records.join(new.where(~blank(F.col("record_id"))).dropDuplicates(["record_id"]), "record_id", "left")
    kept = lambda c, new_: F.when(F.col("edited_"), new_).otherwise(F.col(c))
    out = {"tag": F.coalesce("tag_", "tag"), "user_keywords": F.coalesce("words_", "user_keywords"), "retrieval_source_mode": kept("retrieval_source_mode", F.col("mode_")), "direct_recall_key": kept("direct_recall_key", F.col("key_"))}
    changed = ~F.struct(*(out[f] for f in out)).eqNullSafe(F.struct(*(F.col(f) for f in out)))
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in records.columns), changed.alias("changed"))


# Fields of a record in the log and in the index, and those that only the index has.
LOG_FIELDS = "record_id parent_id created_at_utc input_text output_text source input_hash output_hash active_retrieval_brief_title active_retrieval_brief active_retrieval_brief_contributor_ids".split()
INDEX_FIELDS = "record_id parent_id created_at_utc source tag retrieval_source_mode direct_recall_key auto_keywords user_keywords active_project_name embedded_files_snapshot input_hash output_hash".split()
FULL_FIELDS = LOG_FIELDS + "tag retrieval_source_mode direct_recall_key auto_keywords user_keywords active_project_name embedded_files_snapshot".split()
LISTS = ("auto_keywords", "user_keywords", "embedded_files_snapshot", "active_retrieval_brief_contributor_ids")
#: What a field is where a record doesn't have it; others are empty texts, those of OPTIONAL null.
FIELD_DEFAULTS, OPTIONAL = {"tag": "Green", "retrieval_source_mode": "QA"}, ("parent_id", "active_project_name")


def record_form(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows in one of the forms of a record: its fields in order, with defaults for columns and values that aren't there."""

    def field(name: str) -> Column:
        if name in LISTS:
            nothing = F.array().cast("array<string>")
            return F.coalesce(F.col(name), nothing) if name in rows.columns else nothing
        value = F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
        return value if name in OPTIONAL else F.coalesce(value, F.lit(FIELD_DEFAULTS.get(name, "")))

    return rows.select(*(field(f).alias(f) for f in fields))


def index_rows(rows: DataFrame) -> DataFrame:
    """Rows of an index whose lists are JSON texts, as candidates with arrays; a text that isn't a list of texts is an empty one."""
    decoded = {c: F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>")) for c in LISTS if c in rows.columns}
    return rows.withColumns(decoded)


def pack_or_reason(requests: DataFrame, pack: DataFrame) -> DataFrame:
    """Rows of every request's pack, or one row with no slot and the reason why it is empty.

    requests: request_id, file_id (null: no file is active), query. pack: file_id, slot, record_id, pos.
    """
    reason = F.when(F.col("file_id").isNull(), "no_active_file").when(blank(F.col("query")), "empty_query")
    asked = requests.select("request_id", "file_id", reason.alias("reason"))
    rows = asked.where("reason IS NULL").join(pack, "file_id").select("request_id", "reason", "slot", "record_id", "pos")
    none = asked.where("reason IS NOT NULL").select("request_id", "reason", *(F.lit(None).cast(t).alias(c) for c, t in (("slot", "string"), ("record_id", "string"), ("pos", "long"))))
    return rows.unionByName(none)


def enrich(candidates: DataFrame, live: DataFrame, episodes: DataFrame, fields: list[str], key: str = "record_id") -> DataFrame:
    """Fields of episodes over live records over candidates."""
    take = lambda df, x: df.select(key, *(F.col(f).alias(f"{f}_{x}") for f in fields if f in df.columns))
    joined = candidates.join(take(live, "live"), key, "left").join(take(episodes, "episode"), key, "left")
    pick = lambda f: F.coalesce(*(F.col(c) for c in (f"{f}_episode", f"{f}_live", f) if c in joined.columns))
    return joined.select(*(c for c in candidates.columns if c not in fields), *(pick(f).alias(f) for f in fields))


def first_filled(*columns: Column) -> Column:
    """The first of the columns that isn't blank, stripped; else an empty text."""
    return F.coalesce(*(F.when(~blank(c), strip(c)) for c in columns), F.lit(""))


def latest_brief(recs: DataFrame, brief: str = "brief") -> DataFrame:
    """Per file the newest brief that isn't blank, of records that aren't excluded."""
    rows = without_tags(recs).where(~blank(F.col(brief)))
    return rows.groupBy("file_id").agg(F.max_by(F.struct("record_id", F.col(brief).alias("brief")), F.struct("ordinal", "record_id")).alias("b")).select("file_id", "b.*")


def clean_brief(recs: DataFrame, contributors: str = "contributors", brief: str = "brief") -> DataFrame:
    """The same, without briefs that any Black record contributed to; no contributors means the record itself."""
    black = recs.where("tag = 'Black'").select(F.col("record_id").alias("contributor"))
    own = F.when(F.coalesce(F.size(contributors), F.lit(0)) > 0, F.col(contributors)).otherwise(F.array("record_id"))
    tainted = recs.select("record_id", F.explode(own).alias("contributor")).join(black, "contributor", "left_semi").select("record_id").distinct()
    return latest_brief(recs.join(tainted, "record_id", "left_anti"), brief)
