"""Label gate, class groups, budgets and decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank, norm_phrase, once, sentence_windows, sentences, strip
from ..functions.vectors import centroid, cosine, top_mean, word_vectors

# What each pair of materiality and relation leads to.
DECISIONS = (
    ("STRONG", "NO_ACTIVEBRIEF", False, "none", True, "normal_no_activebrief"),
    ("WEAK", "NO_ACTIVEBRIEF", False, "none", True, "normal_no_activebrief"),
    ("STRONG", "SAME_TOPIC", False, "full_activebrief", True, "allowed"),
    ("WEAK", "SAME_TOPIC", True, "full_activebrief", True, "allowed"),
    ("STRONG", "RELATED_DOMAIN", False, "title_related_domain_note", True, "allowed_related_domain"),
    ("WEAK", "RELATED_DOMAIN", True, "title_related_domain_note", True, "allowed_related_domain"),
    ("STRONG", "IRRELEVANT", False, "title_topic_shift_note", False, "disabled"),
    ("WEAK", "IRRELEVANT", False, "none", False, "disabled"),
)
ROUTES = ("init_no_previous_activebrief", "skip_no_qa_vectors", "activebrief_safe_pass", "activebrief_update", "pending_topic_shift", "skip_and_update_pending_topic")


def decision_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DECISIONS, "materiality string, relation string, brief_for_retrieval boolean, prompt_mode string, memory_allowed boolean, memory_policy string")


def decide(states: DataFrame) -> DataFrame:
    """states (materiality, relation) with the decision; an unknown pair is an error when its row is computed."""
    joined = states.join(F.broadcast(decision_table(states.sparkSession)), ["materiality", "relation"], "left")
    known = F.when(F.col("prompt_mode").isNull(), F.raise_error(F.concat_ws(" ", F.lit("unknown state"), "materiality", "relation"))).otherwise(F.col("prompt_mode"))
    return joined.withColumn("prompt_mode", known)


def relation_state(materiality: Column, relation: Column) -> Column:
    return F.when(relation == "NO_ACTIVEBRIEF", relation).otherwise(F.concat_ws("_", materiality, relation))


def usefulness(quality: Column, toxic: Column) -> Column:
    """useful, borderline or discarded; borderline where nothing is known."""
    return F.when(toxic == 1, "discarded").when(quality == 1, "useful").otherwise("borderline")


def gate(ranked: DataFrame, labels: DataFrame, cap: int = 30, key: str = "id") -> DataFrame:
    """The first ``cap`` candidates with their label; a missing one is borderline."""
    return ranked.where(F.col("rank") <= cap).join(labels.select(key, "label"), key, "left").withColumn("label", F.coalesce("label", F.lit("borderline")))


def useful(gated: DataFrame, n: int = 12) -> DataFrame:
    """The first n useful ones by rank, with local ids from "1" on."""
    order = Window.orderBy("rank")  # at most as many rows as the gate lets in
    return gated.where("label = 'useful'").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n).withColumn("local_id", F.col("pos").cast("string")).drop("pos")


def active_classes(classes: DataFrame) -> DataFrame:
    """Definitions with a known id, a phrase and a context."""
    return classes.where(F.col("class_id").isin("ID1", "ID2", "ID3", "ID4") & ~blank(F.col("phrase")) & ~blank(F.col("context")))


def assign_class(items: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id of items (item, answer): by id, else by exact phrase, else by normalised phrase, else null."""
    c = classes.select("class_id", "phrase", norm_phrase(F.col("phrase")).alias("norm"), "priority")
    first = lambda key, name: F.broadcast(c.groupBy(key).agg(F.min_by("class_id", "priority").alias(name)))
    out = items.withColumn("norm", norm_phrase(F.col("answer"))).withColumn("class_id", strip(F.col("answer"))).withColumn("phrase", F.col("answer"))
    out = out.join(first("class_id", "by_id"), "class_id", "left").join(first("phrase", "by_phrase"), "phrase", "left").join(first("norm", "by_norm"), "norm", "left")
    return out.select("item", "answer", F.coalesce("by_id", "by_phrase", "by_norm").alias("class_id"))


def group_classes(assigned: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id, priority, items in order; classes without items are left out."""
    items = F.array_sort(F.collect_list("item"))
    return assigned.groupBy("class_id").agg(items.alias("items")).join(F.broadcast(classes.select("class_id", "priority")), "class_id").select("class_id", "priority", "items")


def budget_tier(tokens: Column) -> tuple[Column, Column]:
    """Name and number of class groups for a token limit; a limit that isn't positive counts as 3000."""
    t = F.when(F.coalesce(tokens, F.lit(0)) <= 0, 3000).otherwise(tokens)
    return F.when(t < 1200, "tight").when(t < 1800, "narrow").when(t < 2600, "medium").otherwise("broad"), F.when(t < 1200, 1).when(t < 1800, 2).when(t < 2600, 3).otherwise(None).cast("long")


def selected_order(chosen: DataFrame, prior: DataFrame) -> DataFrame:
    """id, status, score of the ordered union of chosen and prior ids (id, pos), each once, chosen ones first.

    Of n ids the i-th scores n - i + 1 if it is chosen; ids that were only selected before are DISCARDED with 0.
    """
    both = chosen.select("id", F.lit(0).alias("list"), "pos").unionByName(prior.select("id", F.lit(1).alias("list"), "pos")).groupBy("id").agg(F.min(F.struct("list", "pos")).alias("at"))
    placed = both.select("id", "at", F.row_number().over(Window.orderBy("at")).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))  # a selection: tens of rows
    is_chosen = F.col("at.list") == 0
    return placed.select("id", F.when(is_chosen, "SELECTED").otherwise("DISCARDED").alias("status"), F.when(is_chosen, F.col("n") - F.col("i") + 1).otherwise(0).cast("long").alias("score"))


def empty_selection(gated: DataFrame, reason: str = "a3_selected_zero_useful_chunks") -> DataFrame:
    """Where no candidate is useful: all of them discarded with score 0, and why; no rows where one is."""
    useful_ones = gated.where("label = 'useful'").agg(F.count("*").alias("n_useful"))
    return gated.crossJoin(F.broadcast(useful_ones)).where("n_useful = 0").select("id", F.lit("DISCARDED").alias("status"), F.lit(0).cast("long").alias("score"), F.lit(reason).alias("reason"))  # one row


def brief_scores(rows: DataFrame, size: int = 64) -> DataFrame:
    """rows (input_text, output_text, brief, pending) with n_vectors, has_centre, brief_mean and pending_mean.

    A record's windows of question and answer are compared with the centroid of the brief's windows, and with
    that of the pending topic's; a mean is of the most similar ones, and null without a centroid.
    """
    encoded = lambda c: word_vectors(sentence_windows(sentences(c)), size)
    made = rows.withColumns({"own_": F.concat(encoded(F.col("input_text")), encoded(F.col("output_text"))), "brief_": centroid(encoded(F.col("brief")), size), "pending_": centroid(encoded(F.col("pending")), size)})
    mean = lambda c: F.when(F.col(c).isNotNull(), once(F.col(c), lambda centre: once(F.transform("own_", lambda v: cosine(v, centre)), top_mean)))
    return made.select(*rows.columns, F.size("own_").alias("n_vectors"), F.col("brief_").isNotNull().alias("has_centre"), mean("brief_").alias("brief_mean"), mean("pending_").alias("pending_mean"))


def route(has_brief: Column, n_vectors: Column, has_centre: Column, brief_mean: Column, pending_mean: Column, least: float = 0.25) -> Column:
    """Where a new record's brief goes; pending_mean is null without a pending topic."""
    init, none, safe, update, shift, skip = ROUTES
    return F.when(~has_brief, init).when(n_vectors <= 0, none).when(~has_centre, safe).when(brief_mean >= least, update).when(F.coalesce(pending_mean, F.lit(-1.0)) >= least, shift).otherwise(skip)
