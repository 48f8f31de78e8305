"""A running brief per file: an ordered fold over its records, the same in a batch and over a stream.

The state is the brief so far (kept sentences, the sum and number of the window vectors of all records it comes from,
their ids) and the topic that is pending. A record's windows are compared with the brief's centroid, then with the
pending topic's: it starts a brief, adds to it, confirms with the pending record that the topic has shifted, or
leaves the brief as it is and becomes the pending topic itself. A new brief keeps, of the sentences before and the
record's, those closest to the new centroid that fit the token budget and resemble none kept before, in their order.
A brief that a Black record contributed to isn't carried on: the next record meets the one before.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentence_windows, sentences
from ..functions.vectors import word_vectors
from ..streaming.folds import Step, fold, fold_stream
from .gate import ROUTES

BUDGET, LEAST, REDUNDANT, TITLE_WORDS, SIZE = 700, 0.25, 0.92, 8, 64
OUTPUT = "file_id {key}, record_id string, route string, title string, brief string, contributors array<string>, n_vectors long, centre array<double>, brief_mean double, pending_mean double, pending_id string"
ORDER = ["ordinal", "record_id"]


def encoded(records: DataFrame, size: int = SIZE) -> DataFrame:
    """Records (file_id, record_id, ordinal, tag, input_text, output_text and others) with their sentences, a vector for each, and one for each window of question and answer."""
    q, a = sentences(F.col("input_text")), sentences(F.col("output_text"))
    windows = lambda x: word_vectors(sentence_windows(x), size)
    rest = [c for c in records.columns if c not in ("input_text", "output_text")]
    return records.select(*rest, F.concat(q, a).alias("sentences"), word_vectors(F.concat(q, a), size).alias("vectors"), F.concat(windows(q), windows(a)).alias("windows"))


def estimate(text: str) -> int:
    """A quarter of the characters, rounded up."""
    return math.ceil(len(text) / 4)


def _likeness(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Cosines of rows with a vector, 0 for zero ones."""
    length = np.linalg.norm(vectors, axis=1) * np.linalg.norm(centre)
    return np.divide(vectors @ centre, length, out=np.zeros(len(vectors)), where=length > 0)


def _top_mean(scores: np.ndarray) -> float:
    n = len(scores)
    take = n if n <= 4 else 4 if n <= 20 else max(1, n // 5)
    return float(np.mean(np.sort(scores)[::-1][:take]))


def kept_sentences(listed: list[tuple[str, list[float]]], centre: np.ndarray, budget: int, tokens: Callable[[str], int] = estimate, redundant: float = REDUNDANT) -> tuple[list[tuple[str, list[float]]], str]:
    """Of (sentence, vector) those to keep, in order, and a title: the first words of the one closest to the centre. One at least is kept."""
    if not listed:
        return [], ""
    x = np.array([v for _, v in listed])
    length = np.linalg.norm(x, axis=1)
    unit = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)
    order = np.argsort(-_likeness(x, centre), kind="stable").tolist()
    taken, used = [], 0
    for i in order:
        n = tokens(listed[i][0])
        if used + n <= budget and not (taken and float((unit[taken] @ unit[i]).max()) >= redundant):
            taken.append(i)
            used += n
    taken = sorted(taken or order[:1])
    return [listed[i] for i in taken], " ".join(listed[order[0]][0].split()[:TITLE_WORDS])


def brief_step(least: float = LEAST, pending_least: float | None = None, budget: int = BUDGET, tokens: Callable[[str], int] = estimate, gated: bool = True) -> Step:
    """The fold's step. Not ``gated``: every record updates the brief."""
    init, none, safe, update, shift, skip = ROUTES
    pending_bar = least if pending_least is None else pending_least

    def step(state: dict | None, row: dict[str, Any]) -> tuple[dict, tuple]:
        state = state or {}
        brief, pending = state.get("brief"), state.get("pending")
        own = np.array(row["windows"] or [], float)
        new = {"id": row["record_id"], "black": row["tag"] == "Black", "sentences": list(zip(row["sentences"] or [], row["vectors"] or [], strict=True)), "total": own.sum(axis=0).tolist() if len(own) else None, "n": len(own)}
        brief_mean = pending_mean = None
        if not brief:
            route = init
        elif not gated:
            route = "gate_disabled"
        elif not len(own):
            route = none
        elif not brief["n"]:
            route = safe
        else:
            brief_mean = _top_mean(_likeness(own, np.array(brief["total"])))
            if brief_mean < least and pending and pending["n"]:
                pending_mean = _top_mean(_likeness(own, np.array(pending["total"])))
            route = update if brief_mean >= least else shift if pending_mean is not None and pending_mean >= pending_bar else skip
        parts = [] if route in (none, safe, skip) else [pending, new] if route == shift else [new]
        black = any(p["black"] for p in parts)
        out = brief
        if parts:
            summed = [p for p in ([brief] if brief else []) + parts if p["n"]]
            total = np.sum([p["total"] for p in summed], axis=0) if summed else None
            n = sum(p["n"] for p in summed)
            listed = [tuple(s) for s in (brief["sentences"] if brief else [])] + [s for p in parts for s in p["sentences"]]
            held, title = kept_sentences(listed, total if total is not None else np.zeros(SIZE), budget, tokens)
            ids = list(dict.fromkeys([*(brief["ids"] if brief else []), *(p["id"] for p in parts)]))
            out = {"title": title, "sentences": held, "total": None if total is None else total.tolist(), "n": n, "ids": ids}
        after = {"brief": brief if black or not (out and out["sentences"]) else out, "pending": None if parts else new}
        centre = [x / out["n"] for x in out["total"]] if out and out["n"] else None
        text = " ".join(s for s, _ in out["sentences"]) if out else ""
        made = (row["file_id"], row["record_id"], route, out["title"] if out else "", text, out["ids"] if out else [], out["n"] if out else 0, centre, brief_mean, pending_mean, after["pending"]["id"] if after["pending"] else "")
        return after, made

    return step


def _schema(records: DataFrame) -> str:
    return OUTPUT.format(key=records.schema["file_id"].dataType.simpleString())


def _sparse(records: DataFrame) -> DataFrame:
    """Encoded records whose vectors are places and numbers in turn, zeros left out: most are, and rows go to Python as texts."""
    some = lambda v: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda d: F.get(v, d) != 0)
    pairs = lambda vs: F.transform(vs, lambda v: F.flatten(F.transform(some(v), lambda d: F.array(d.cast("double"), F.get(v, d)))))
    return records.withColumns({c: pairs(F.col(c)) for c in ("vectors", "windows")})


def _dense(pairs: list[list[float]] | None) -> list[list[float]]:
    out = np.zeros((len(pairs or []), SIZE))
    for x, p in zip(out, pairs or [], strict=True):
        x[np.array(p[::2], int)] = p[1::2]
    return out.tolist()


def _on_sparse(step: Step) -> Step:
    return lambda state, row: step(state, row | {c: _dense(row[c]) for c in ("vectors", "windows")})


def running_briefs(records: DataFrame, time: str, step: Step | None = None, idle: int | None = None) -> DataFrame:
    """Every record's route and the brief after it; records as for ``encoded``, with a time. Files of a null id are one."""
    return fold(_sparse(encoded(records)), "file_id", time, ORDER, _on_sparse(step or brief_step()), _schema(records), idle)


def brief_stream(records: DataFrame, time: str, delay: str, step: Step | None = None, idle: int | None = None) -> DataFrame:
    """The same over a stream of records, whose output comes once the watermark has passed them."""
    return fold_stream(_sparse(encoded(records)), "file_id", time, ORDER, _on_sparse(step or brief_step()), _schema(records), delay, idle)


def pending_step(least: float = LEAST) -> Step:
    """Routes by a score that rows bring along: what passes, what is pending, and what confirms a pending record because its score is as near."""

    def step(state: dict | None, row: dict[str, Any]) -> tuple[dict, tuple]:
        pending, score = (state or {}).get("pending", ""), (state or {}).get("score", 0.0)
        if row["brief_score"] >= least:
            route, pending, score = ROUTES[3], "", 0.0
        elif pending and abs(row["brief_score"] - score) <= least:
            route, pending, score = ROUTES[4], "", 0.0
        else:
            route, pending, score = ROUTES[5], row["record_id"], row["brief_score"]
        return {"pending": pending, "score": score}, (row["file_id"], row["record_id"], route, pending)

    return step

