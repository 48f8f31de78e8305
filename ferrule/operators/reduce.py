"""Order-dependent reducers: one record at a time, so each is a small function over Arrow batches of records."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import auto_keywords, blank, first_words, once, sentence_windows, sentences, strip, token_estimate, window_places
from ..functions.vectors import centroid, qa_budget, word_vectors

REDUNDANT, TARGET, MOST, ANCHOR_WORDS = 0.92, 500, 800, 220
BLOCKS = "array<struct<start:int,end:int,n_words:int,text:string>>"


def keep_within(items: Column, budget: int) -> Column:
    """Items in order while their token estimates fit: one that doesn't fit is skipped, later ones may."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        n = token_estimate(x)
        return F.when(acc["used"] + n > budget, acc).otherwise(F.struct((acc["used"] + n).alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept")))

    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def _tokens(text: str) -> int:
    return max(1, math.ceil(len(text) / 4)) if text else 0


def reduce_text(sentences: list[str], windows: list[list[int]], vectors: np.ndarray, anchor: np.ndarray, budget: int, redundant: float = REDUNDANT) -> list[int]:
    """Sentences to keep: windows are taken by similarity to the anchor, if they fit and resemble none taken before; one at least."""
    if not len(windows) or budget <= 0:
        return []
    lengths = np.linalg.norm(vectors, axis=1)
    unit = np.divide(vectors, lengths[:, None], out=np.zeros_like(vectors, dtype=float), where=lengths[:, None] > 0)
    size = np.linalg.norm(anchor)
    score = unit @ (anchor / size) if size > 0 else np.zeros(len(windows))
    taken: list[int] = []
    used = 0
    order = np.argsort(-score, kind="stable")
    for w in order.tolist():
        n = _tokens(" ".join(sentences[i] for i in windows[w]))
        if used + n <= budget and not (taken and float((unit[taken] @ unit[w]).max()) >= redundant):
            taken.append(w)
            used += n
    taken = taken or [int(order[0])]
    kept, used = [], 0
    for i in sorted({i for w in taken for i in windows[w]}):
        n = _tokens(sentences[i])
        if used + n <= budget:
            kept.append(i)
            used += n
    return kept


def reduce_records(rows: DataFrame, budget: int | Column, key: str = "record_id", text: bool = False) -> DataFrame:
    """key, kept (sentence numbers), n_tokens, and the kept text if asked for: rows have sentences, windows (lists of sentence numbers), vectors, anchor.

    A text within budget is kept whole. A record's windows are one row, so nothing is grouped.
    """
    most = budget if isinstance(budget, Column) else F.lit(budget)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, s, w, v, a, budget in zip(b[key], b["sentences"], b["windows"], b["vectors"], b["anchor"], b["budget_"].tolist(), strict=True):
                s = list(s)
                if _tokens(" ".join(s)) <= budget:
                    kept = list(range(len(s)))
                else:
                    kept = reduce_text(s, [list(x) for x in w], np.array([list(x) for x in v], float), np.array(a, float), budget)
                out.append((k, kept, sum(_tokens(s[i]) for i in kept), *([" ".join(s[i] for i in kept)] if text else [])))
            yield pd.DataFrame(out, columns=[key, "kept", "n_tokens", *(["text"] if text else [])])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "sentences", "windows", "vectors", "anchor", most.alias("budget_")).mapInPandas(run, f"{key} {kind}, kept array<int>, n_tokens long{', text string' if text else ''}")


SIZE = 64  # of the stand-in's vectors


def reduce_pairs(recs: DataFrame, total: int, question_most: int) -> DataFrame:
    """record_id, question, answer: both cut to their share of the tokens, by similarity to the centroid of all windows of the two."""
    q, a = sentences(F.col("input_text")), sentences(F.col("output_text"))
    encoded = recs.select("record_id", "input_text", "output_text", q.alias("q"), a.alias("a"), *(word_vectors(sentence_windows(x), SIZE).alias(n) for x, n in ((q, "qv"), (a, "av"))))
    encoded = encoded.withColumn("anchor", centroid(F.concat("qv", "av"), SIZE))
    budgets = qa_budget(token_estimate(F.col("input_text")), token_estimate(F.col("output_text")), total, question_most)
    side = lambda n, v, budget: F.struct(F.lit(n).alias("side"), F.col(n).alias("sentences"), F.col(v).alias("vectors"), budget.alias("budget"))
    rows = encoded.select("record_id", "anchor", F.explode(F.array(side("q", "qv", budgets[0]), side("a", "av", budgets[1]))).alias("s")).select("record_id", "anchor", "s.*")
    rows = rows.withColumns({"key": F.concat_ws(":", "side", "record_id"), "windows": window_places(F.col("sentences"))})
    kept = reduce_records(rows, F.col("budget"), "key", text=True)
    pick = lambda n: F.max(F.when(F.col("key").startswith(f"{n}:"), F.col("text")))
    return kept.groupBy(F.substring("key", 3, 1 << 30).alias("record_id")).agg(pick("q").alias("question"), pick("a").alias("answer"))


PARAGRAPH = re.compile(r"\S(?:.*?\S)??(?=\n\s*\n|\s*\Z)", re.DOTALL)
SENTENCE = re.compile(r"\S[^.!?\n]*(?:[.!?]+|$)")
WORD = re.compile(r"\S+")


def _units(text: str, most: int) -> list[tuple[int, int]]:
    """Paragraphs by offset; one of more than ``most`` words by its sentences."""
    units = []
    for p in PARAGRAPH.finditer(text):
        if len(WORD.findall(p[0])) <= most:
            units.append(p.span())
        else:
            units += [(p.start() + s.start(), p.start() + s.end()) for s in SENTENCE.finditer(p[0])]
    return units


def text_blocks(text: str | None, target: int = TARGET, most: int = MOST) -> list[dict]:
    """Units packed in order to blocks of ``target`` to ``most`` words; a unit beyond that is cut at words."""
    out: list[dict] = []
    held: list[tuple[int, int]] = []
    count = 0

    def flush() -> None:
        nonlocal held, count
        if held:
            body = "\n\n".join(text[a:b].strip() for a, b in held)
            out.append({"start": held[0][0], "end": held[-1][1], "n_words": len(WORD.findall(body)), "text": body})
        held, count = [], 0

    for a, b in _units(text or "", most):
        words = list(WORD.finditer(text, a, b))
        if len(words) > most:
            flush()
            for i in range(0, len(words), most):
                part = words[i : i + most]
                out.append({"start": part[0].start(), "end": part[-1].end(), "n_words": len(part), "text": text[part[0].start() : part[-1].end()]})
            continue
        if held and count + len(words) > most:
            flush()
        held.append((a, b))
        count += len(words)
        if count >= target:
            flush()
    flush()
    return out


def blocks(text: str) -> Column:
    """Blocks of a text column, by ``text_blocks``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([text_blocks(t) for t in b], dtype=object)

    return F.pandas_udf(run, BLOCKS)(text)


# Names of metadata lines, and marks of a prompt's end.
METADATA = ["title", "author", "version", "updated", "tags", "date", "created", "modified", "description"]
END_MARKS = ["END_OF_PROMPT", "## END_OF_PROMPT", "### END_OF_PROMPT"]


def clean_chunk(text: Column) -> Column:
    """Without front matter, fences, meta and end marks, metadata lines and repeated blank lines."""
    whole = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"))
    named = lambda x: F.contains(x, F.lit(":")) & x.rlike(rf"(?i)^({'|'.join(METADATA)})\s*:")
    noise = lambda x: x.startswith("```") | F.lower(F.substring(x, 1, 6)).startswith("@@meta") | x.isin(*END_MARKS) | named(x)

    def body(lines: Column) -> Column:
        headed = F.get(lines, F.lit(0)) == "---"
        end = F.array_position(F.transform(lines, lambda x, i: (i > 0) & x.isin("---", "...")), True)
        return F.when(~headed, lines).when(end == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, end.cast("int") + 1, F.size(lines)))

    kept = F.array_join(F.filter(once(F.transform(F.split(whole, "\n"), strip), body), lambda x: ~noise(x)), "\n")
    return strip(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def memory_entries(recs: DataFrame) -> DataFrame:
    """vector_id, record_id, role, block, text: a handle (file, keywords of both texts, start of the question), question blocks and answer blocks per record."""
    split = recs.withColumns({"q": blocks("input_text"), "a": blocks("output_text")})
    anchor = first_words(F.coalesce(F.get(F.col("q"), 0)["text"], F.lit("")), ANCHOR_WORDS)
    words = F.array_join(auto_keywords(F.concat_ws("\n", "input_text", "output_text")), ", ")
    handle = F.concat_ws("\n", F.concat(F.lit("PROJECT: "), F.col("file_id").cast("string")), F.concat(F.lit("KEYWORDS: "), words), F.lit("QUESTION_ANCHOR:"), anchor)
    entry = lambda role, texts: F.transform(texts, lambda x, i: F.struct(F.lit(role).alias("role"), i.alias("block"), x.alias("text")))
    listed = F.concat(entry("handle", F.array(handle)), entry("question", F.transform("q", lambda x: x["text"])), entry("answer", F.transform("a", lambda x: x["text"])))
    rows = split.select("record_id", F.explode(listed).alias("e")).where(~blank(F.col("e.text")))
    return rows.select(F.concat_ws("::", "record_id", "e.role", F.col("e.block").cast("string")).alias("vector_id"), "record_id", "e.role", F.col("e.block").cast("long").alias("block"), "e.text")
