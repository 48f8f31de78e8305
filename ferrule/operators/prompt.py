"""Prompts: sections under headings, names of sections, and the texts that retrieval is asked with."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, norm_key, strip

BODY = ("system", "task", "audience", "role", "tone", "depth", "context", "purpose", "format", "text")


def sections(c: Column) -> Column:
    """Array of (level, title, body) of headings of levels 1 to 3; text before the first one is dropped."""
    text = F.concat(F.lit("\n"), F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"))
    parts = F.split(text, r"\n(?=#{1,3}\s*\S)")
    headed = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(
        headed,
        lambda p: F.struct(F.length(F.regexp_extract(p, r"^(#{1,3})", 1)).alias("level"), strip(F.regexp_extract(p, r"^#{1,3}\s*(.+)", 1)).alias("title"), strip(F.regexp_replace(p, r"^#{1,3}\s*.+\n?", "")).alias("body")),
    )


def resolve_headers(headers: DataFrame, names: DataFrame) -> DataFrame:
    """headers (title, ...) with ``canonical``: names (name, canonical, priority) in canonical, alias, bilingual order; null if none fits."""
    keyed = names.select(norm_key(F.col("name")).alias("key_"), "canonical", "priority").groupBy("key_").agg(F.min_by("canonical", "priority").alias("canonical"))
    return headers.withColumn("key_", norm_key(F.col("title"))).join(F.broadcast(keyed), "key_", "left").drop("key_")  # a schema's names


def preprocess(prompts: DataFrame, names: DataFrame, must: dict[str, str], key: str = "prompt_id", text: str = "text") -> DataFrame:
    """key, name, body: the canonical sections of prompts, the last of a name; rules for a missing task, defaults for others."""
    rows = prompts.select(key, F.posexplode(sections(F.col(text))).alias("pos", "s")).select(key, "pos", "s.title", "s.body")
    named = resolve_headers(rows, names).where("canonical IS NOT NULL").groupBy(key, "canonical").agg(F.max_by("body", "pos").alias("body"))
    wide = named.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("canonical", "body"))).alias("found"))
    base = prompts.select(key, F.col(text).alias("whole"), (F.size(sections(F.col(text))) > 0).alias("headed")).join(wide, key, "left")
    found = lambda k: F.coalesce(F.try_element_at("found", F.lit(k)), F.lit(""))
    promoted = blank(found("task")) & ~blank(found("context"))
    out = {"task": F.when(~F.col("headed"), strip(F.col("whole"))).when(~blank(found("task")), found("task")).when(promoted, strip(found("context"))).otherwise(strip(F.col("whole")))}
    out["context"] = F.when(promoted, "").otherwise(found("context"))
    for k in (*must, *BODY):
        if k not in out:
            out[k] = F.when(F.col("headed") & blank(found(k)), F.lit(must.get(k, ""))).otherwise(found(k))
    return base.select(key, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("body")) for k, v in out.items()))).alias("x")).select(key, "x.name", "x.body").where(~blank(F.col("body")))


def query_text(task: Column, purpose: Column, context: Column, materiality: Column, relation: Column, brief: Column, title: Column) -> Column:
    """What documents are searched with; null where retrieval is off, an error is left to the caller where all are blank."""
    block = lambda name, c: F.when(~blank(c), F.concat(F.lit(f"## {name}\n"), strip(c)))
    weak = materiality == "WEAK"
    parts = (block("TASK", task), block("PURPOSE", purpose), block("CONTEXT", context), F.when(weak & (relation == "SAME_TOPIC"), block("PREVIOUS MEMORY SUMMARY", brief)), F.when(weak & (relation == "RELATED_DOMAIN"), block("PREVIOUS MEMORY TITLE", title)))
    return F.when(weak & (relation == "IRRELEVANT"), "").otherwise(F.concat_ws("\n\n", *parts))


def prompt_blocks(fields: dict[str, Column]) -> Column:
    """Blocks of the fields that aren't blank, in the given order, each under its name."""
    return F.concat_ws("\n\n", *(F.when(~blank(c), F.concat(F.lit(f"## {k.upper()}\n"), strip(c))) for k, c in fields.items()))


def _brief_parts(materiality: Column, relation: Column) -> tuple[Column, Column]:
    """Whether a comparison shows the whole brief, or its title alone."""
    strong, weak = materiality == "STRONG", materiality == "WEAK"
    full = (strong & relation.isin("SAME_TOPIC", "RELATED_DOMAIN")) | (weak & relation.isin("SAME_TOPIC", "IRRELEVANT"))
    title = (strong & (relation == "IRRELEVANT")) | (weak & (relation == "RELATED_DOMAIN"))
    return F.coalesce(full, F.lit(False)), F.coalesce(title, F.lit(False))


def comparison_prompt(task: Column, purpose: Column, context: Column, materiality: Column, relation: Column, brief: Column, title: Column) -> Column:
    """The prompt that chunks are judged against, with the brief, its title or neither, by state."""
    full, only_title = _brief_parts(materiality, relation)
    part = lambda name, c: F.when(~blank(c), F.concat(F.lit(f"{name}:\n"), strip(c), F.lit("\n")))
    parts = (part("TASK", task), part("PURPOSE", purpose), part("CONTEXT", context), F.when(full, part("PREVIOUS MEMORY SUMMARY", brief)), F.when(only_title, part("PREVIOUS MEMORY TITLE", title)))
    return F.concat_ws("\n", F.lit("<user_prompt_under_evaluation>"), *parts, F.lit("</user_prompt_under_evaluation>"))


# Headings of the supporting context and the notes under them.
SUPPORT = ("## Supporting Context", "Priority: supporting only. Use this material only when it helps answer the current TASK.")
SUMMARY = ("### Previous Conversation Summary", "Priority: background only. Use this for continuity, but do not treat it as the current task.")
TOPIC = ("### Previous Conversation Topic", "Priority: weak background only. Use only for continuity or topic-shift awareness.")
MEMORY = ("### Memory Context", "This is synthesized memory context. It is background support, not the current task.")
EVIDENCE = ("### Retrieved Project Evidence Summary", "The following summary is retrieved from selected project files. It is supporting evidence for the current TASK, not the task itself.")
RAW = ("### Raw Retrieved Evidence", "Raw evidence is lower priority than the current TASK and should only support the answer.")


def context_block(materiality: Column, relation: Column, title: Column, brief: Column, memory: Column, summary: Column, raw: Column, stage: Column) -> Column:
    """The supporting context, empty where there is none; raw evidence is hidden once it has been summarised (a4, a5)."""
    full, only_title = _brief_parts(materiality, relation)
    filled = lambda c: F.when(~blank(c), strip(c))
    under = lambda head, *body: F.concat_ws("\n\n", F.lit("\n".join(head)), *body)
    named = F.when(~blank(title), F.concat(F.lit("Title: "), strip(title)))
    parts = (
        F.when(full & (~blank(title) | ~blank(brief)), under(SUMMARY, named, filled(brief))),
        F.when(only_title & ~blank(title), under(TOPIC, named)),
        F.when(~blank(memory), under(MEMORY, filled(memory))),
        F.when(~blank(summary), under(EVIDENCE, filled(summary))),
        F.when(~blank(raw) & ~F.coalesce(stage, F.lit("")).isin("a4", "a5"), under(RAW, filled(raw))),
    )
    body = F.concat_ws("\n\n", *parts)
    return F.when(body == "", "").otherwise(F.concat(F.lit("\n".join(SUPPORT) + "\n\n"), body))


def topic_shift(pending: Column, now: Column, what: str) -> Column:
    """Pending and current reduced text of one side (question or answer), each under its label."""
    part = lambda name, c: F.when(~blank(c), F.concat(F.lit(f"[{name} {what}]\n"), strip(c)))
    return F.concat_ws("\n\n", part("Pending skipped Q/A", pending), part("Current Q/A", now))


def option_labels(chosen: DataFrame, labels: DataFrame, key: str = "prompt_id") -> DataFrame:
    """key, field, text: labels of chosen option ids (key, field, pos, id), joined in order; an id without a label stands for itself."""
    named = labels.select("field", F.col("id").alias("option_"), "label")
    own = chosen.where(~blank(F.col("id"))).withColumn("option_", strip(F.col("id")))
    found = own.join(F.broadcast(named), ["field", "option_"], "left")  # a catalog of options
    text = F.coalesce(F.when(~blank(F.col("label")), strip(F.col("label"))), F.col("option_"))
    listed = F.array_sort(F.collect_list(F.struct("pos", text.alias("text"))))
    return found.groupBy(key, "field").agg(F.array_join(F.transform(listed, lambda x: x["text"]), ", ").alias("text"))


TARGETS = "decision_targets"


def agent_messages(fixed: dict[str, str], bindings: list[dict[str, Any]], payload: dict[str, Column], targets: str = "", order: list[str] | None = None) -> tuple[Column, Column]:
    """System and user message of an agent; an empty user message is one not to be sent.

    The system message has the preamble, the items of ``order`` (names of fixed texts, ids of bindings, or the
    targets, whose place a row's own text may take), then fixed texts and targets that weren't placed. The user
    message has the other bindings (id, prompt_text, visible_in_prompt, required): each its text and the row's value.
    """
    own = {b["id"].strip(): b for b in bindings if (b.get("id") or "").strip()}
    if lacking := [n for n, b in own.items() if b.get("required") and n not in payload]:
        raise ValueError(f"no value for {', '.join(lacking)}")
    places = list(dict.fromkeys(x[3:] if x.lower().startswith("id:") else x for x in map(str.strip, order or []) if x))
    value = lambda n: payload.get(n, F.lit(None).cast("string"))
    filled = lambda c: F.when(~blank(c), strip(c))
    under = lambda title, c: F.when(~blank(c), F.concat(F.lit(f"## {title}\n"), strip(c), F.lit("\n")))
    bound = lambda n: F.concat_ws("\n", filled(F.lit(own[n].get("prompt_text")).cast("string")), filled(value(n)), F.lit(""))
    shown = [n for n, b in own.items() if b.get("visible_in_prompt", True)]

    preamble = F.lit(fixed.get("preamble")).cast("string")
    system, rest = [F.when(~blank(preamble), F.concat(strip(preamble), F.lit("\n")))], [n for n in fixed if n.strip().lower() != "preamble"]
    later = F.lit(targets)
    for n in places:
        if n in own:
            system += [bound(n)] if n in shown else []
        elif n == TARGETS:
            system.append(under("Decision Targets", F.coalesce(filled(value(n)), F.lit(targets))))
            later = F.when(~blank(value(n)), F.lit(targets))
        elif n in rest:
            system.append(under(n, F.lit(fixed[n])))
            rest.remove(n)
    system += [*(under(n, F.lit(fixed[n])) for n in rest), under("Decision Targets", later)]
    return strip(F.concat_ws("\n", *system)), strip(F.concat_ws("\n", F.lit(""), *(bound(n) for n in shown if n not in places)))
