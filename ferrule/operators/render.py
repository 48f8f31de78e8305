"""Texts out of tables: ordered aggregation of one request's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, escape_attr, format_score, mask_headings, mask_structure, strip


def ordered_lines(pos: str, line: Column, sep: str = "\n") -> Column:
    """An aggregate: lines joined in order of pos."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("line")))), lambda x: x["line"]), sep)


def chunks_xml(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One text per request from its chunks: pos, chunk_id, source, info, text."""
    info = F.when(~blank(F.col("info")), F.concat(F.lit(' info="'), escape_attr(F.col("info")), F.lit('"'))).otherwise("")
    body = F.regexp_replace(mask_headings(F.col("text")), "(?m)^", "      ")
    item = F.concat(
        F.lit('  <chunk index="'), F.col("pos").cast("string"), F.lit('" chunk_id="'), escape_attr(F.col("chunk_id")), F.lit('" source="'), escape_attr(F.col("source")), F.lit('"'), info, F.lit(">\n    <chunk_text>\n"), body, F.lit("\n    </chunk_text>\n  </chunk>")
    )
    joined = F.concat(F.lit("<retrieved_chunks>\n"), ordered_lines("pos", item), F.lit("\n</retrieved_chunks>")).alias("xml")
    return chunks.groupBy(*(by or [])).agg(joined)


def score_info(**scores: Column) -> Column:
    """Name=score pairs of the scores that are there."""
    return F.concat_ws(", ", *(F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), format_score(c))) for name, c in scores.items()))


def class_groups_xml(groups: DataFrame) -> DataFrame:
    """Groups (class_id, priority, items) as one text, in order of priority; the fallback without any."""
    item = F.concat(F.lit('<group class="'), escape_attr(F.col("class_id")), F.lit('">\n'), F.array_join(F.transform("items", lambda x: F.concat(F.lit("  "), x.cast("string"))), "\n"), F.lit("\n</group>"))
    return groups.agg(F.coalesce(F.nullif(ordered_lines("priority", item), F.lit("")), F.lit("<unclassified/>")).alias("xml"))


def episodes_text(episodes: DataFrame, by: str = "file_id") -> DataFrame:
    """Numbered episodes with their question and answer, per file."""
    field = lambda name, c: F.when(~blank(c), F.concat(F.lit(f"{name}:\n"), strip(c)))
    item = F.concat_ws("\n", F.concat(F.lit("### Episode "), F.col("pos").cast("string")), F.concat(F.lit("record_id: "), F.col("record_id")), F.concat(F.lit("tag: "), F.col("tag")), field("QUESTION", F.col("input_text")), field("ANSWER", F.col("output_text")))
    return episodes.groupBy(by).agg(ordered_lines("pos", item, "\n\n").alias("text"))


def memory_evidence(episodes: DataFrame, chunks: DataFrame, by: str = "file_id") -> DataFrame:
    """by, text: episodes (pos, record_id, tag, source, score, input_text, output_text), then semantic chunks (pos, vector_id, record_id, role, score, text), each under its heading.

    Blank fields are left out; a side without rows has no heading. A request has few of either.
    """
    line = lambda name, c: F.when(~blank(c.cast("string")), F.concat(F.lit(f"{name}: "), strip(c.cast("string"))))
    field = lambda name, c: F.when(~blank(c), F.concat(F.lit(f"\n{name}:\n"), strip(c)))
    head = lambda name: F.concat(F.lit(f"### {name} "), F.col("pos").cast("string"))
    c = F.col
    episode = F.concat_ws("\n", head("Episode"), F.concat(F.lit("record_id: "), strip(c("record_id"))), line("tag", c("tag")), line("source", c("source")), line("score", c("score")), field("QUESTION", c("input_text")), field("ANSWER", c("output_text")))
    chunk = F.concat_ws("\n", head("Semantic Chunk"), line("vector_id", c("vector_id")), line("record_id", c("record_id")), line("role", c("role")), line("score", c("score")), field("TEXT", c("text")))
    rows = episodes.select(by, F.lit(0).alias("side"), "pos", episode.alias("line")).unionByName(chunks.select(by, F.lit(1).alias("side"), "pos", chunk.alias("line")))
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(c("side") == side, F.struct("pos", "line")))), lambda x: x["line"])
    under = lambda title, side: F.when(F.size(listed(side)) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(listed(side), "\n\n")))
    return rows.groupBy(by).agg(F.concat_ws("\n\n", under("Reduced Episodic Memory Episodes", 0), under("Semantic Memory Chunks", 1)).alias("text"))


def chunk_order(requests: DataFrame, views: DataFrame, final: DataFrame, base: DataFrame, key: str = "prompt_id") -> DataFrame:
    """key, id, pos: the order of a prompt's base chunks, numbered anew.

    requests: key, stage. views: key, stage, id, pos. final, base: key, id, pos. At stage a3 with a view of it, that view;
    else the final selection, if there is one; else the stage's view, if there is one; else the base order. Ids that
    aren't base chunks are left out.
    """
    seen = views.select(key, "stage").distinct().withColumn("viewed_", F.lit(True))
    chosen = final.select(key).distinct().withColumn("final_", F.lit(True))
    asked = requests.join(seen, [key, "stage"], "left").join(chosen, key, "left")
    viewed, fixed = F.coalesce("viewed_", F.lit(False)), F.coalesce("final_", F.lit(False))
    asked = asked.select(key, "stage", F.when(viewed & (F.col("stage") == "a3"), "view").when(fixed, "final").when(viewed, "view").otherwise("base").alias("from_"))
    rows = asked.where("from_ = 'view'").join(views, [key, "stage"]).select(key, "id", "pos")
    for name, table in (("final", final), ("base", base)):
        rows = rows.unionByName(asked.where(f"from_ = '{name}'").join(table, key).select(key, "id", "pos"))
    rows = rows.join(base.select(key, "id").distinct(), [key, "id"], "left_semi")
    return rows.select(key, "id", F.row_number().over(Window.partitionBy(key).orderBy("pos", "id")).cast("long").alias("pos"))  # a prompt's chunks


def diagnostics_json(selection: Column, synthesis: Column) -> Column:
    """The fenced JSON of what was selected and synthesised, both maps of texts; null where both are empty."""
    given = lambda m: F.coalesce(F.size(m), F.lit(0)) > 0
    own = lambda m: F.when(given(m), m).otherwise(F.create_map().cast("map<string,string>"))
    body = F.to_json(F.struct(own(selection).alias("selection_diagnostics"), own(synthesis).alias("memory_synthesis_diagnostics")), {"pretty": "true"})
    return F.when(given(selection) | given(synthesis), fenced(body, "json"))


def prompt_ready(system: Column, request: Column, context: Column, attachments: Column) -> Column:
    block = lambda name, c: F.when(~blank(c), F.concat(F.lit(f"# {name}\n"), strip(c)))
    return F.concat_ws("\n\n", block("System", system), block("Request", request), block("Context", context), block("Attachments", attachments))


def evidence_xml(chunks: DataFrame, by: list[str] | None = None, source: bool = False) -> DataFrame:
    """One text per request from its chunks (pos, text, and source if asked for): ids are places, not stored ids; structure in texts is masked."""
    index = F.col("pos").cast("string")
    ids = F.concat(F.lit('" chunk_id="'), index)
    head = F.concat(F.lit('  <chunk rank="'), index, ids, F.lit('" source="'), F.coalesce("source", F.lit("")), F.lit('">')) if source else F.concat(F.lit('  <chunk index="'), index, ids, F.lit('" rank="'), index, F.lit('">'))
    lines = F.array_join(F.transform(F.split(mask_structure(F.col("text")), "\n"), lambda x: F.concat(F.lit("      "), x)), "\n")
    item = F.concat(head, F.lit("\n    <chunk_text>\n"), lines, F.lit("\n    </chunk_text>\n  </chunk>"))
    return chunks.groupBy(*(by or [])).agg(F.concat(F.lit("<evidence_chunks>\n"), ordered_lines("pos", item), F.lit("\n</evidence_chunks>")).alias("xml"))


# The head and the sections of a listing of memory candidates, in order.
CANDIDATES = "### Raw Memory Retrieval Candidates\n\nThese are raw memory candidates produced by the Retrieval stage.\nThey are not final prompt context."
SECTIONS = ("Synthesized Memory Context", "Working Memory Candidates", "Episodic Candidates", "Semantic Memory Chunks", "Direct Recall Candidate", "Selection Diagnostics")


def fenced(text: Column, kind: str = "text", title: str = "") -> Column:
    """A text in a fence under its title; null where it is blank."""
    return F.when(~blank(text), F.concat(F.lit(f"{title}```{kind}\n"), strip(text), F.lit("\n```")))


def question_answer(question: Column, answer: Column) -> Column:
    both = F.concat_ws("\n", fenced(question, title="INPUT\n"), fenced(answer, title="OUTPUT\n"))
    return F.when(both == "", "(no Q/A body available)").otherwise(both)


def candidate(name: Column, id_: Column, fields: dict[str, Column], body: Column) -> Column:
    """A candidate's name and id, its fields, a line each, and its body if it has one."""
    line = lambda k, c: F.concat(F.lit(f"- {k}: `"), F.coalesce(c.cast("string"), F.lit("")), F.lit("`"))
    head = F.concat(F.lit("**"), name, F.lit(":** `"), F.coalesce(id_.cast("string"), F.lit("")), F.lit("`"))
    return F.concat_ws("\n", head, *(line(k, c) for k, c in fields.items()), F.when(~blank(body), F.concat(F.lit("\n"), body)))


def candidates_markdown(entries: DataFrame, by: str = "file_id") -> DataFrame:
    """by, markdown: entries (section, pos, text) of each pack under all six sections; one without entries says so.

    A pack holds a request's few candidates; they meet by one grouping, whatever table each comes from.
    """
    c = F.col
    listed = lambda s: F.array_sort(F.collect_list(F.when(c("section") == s, F.struct("pos", "text"))))
    joined = lambda s: F.array_join(F.transform(listed(s), lambda x: x["text"]), "\n\n")
    parts = (F.concat(F.lit(f"#### {s}\n"), F.coalesce(F.nullif(joined(s), F.lit("")), F.lit("(none)"))) for s in SECTIONS)
    return entries.groupBy(by).agg(F.concat_ws("\n\n", F.lit(CANDIDATES), *parts).alias("markdown"))
