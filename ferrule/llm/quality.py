"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is its own features and those of its neighbours; the
chain adds how labels follow each other. Forward-backward gives each line's marginal probability
of being good, and the mean of these, weighted by the lines' lengths, a document's quality, which
a logistic curve of fixed slope, whose middle is fitted on the same sample, turns into the score.

The field is fitted on at most ``SAMPLE`` labelled documents of each label, those with the lowest
hash of doc_id (bound documented, a parameter), and of each on at most ``SAMPLE_LINES`` lines that follow
each other, from one that the hash chooses; lines take the document's label. Their features are computed
by Spark; the fit sees numbers only. Scoring is a map over whole texts, all lines of any text.

Null and empty texts are one empty line, with a score like any other. Repeated rows score alike;
without labelled rows of both kinds every score is the share of label 1 (0.5 without labels).
Empty tables are fine; extra columns pass through (columns named like the outputs are replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, texts

SAMPLE, SAMPLE_LINES = 1500, 1000
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()-]")
N_FEATURES = 10


def line_features(line: str) -> tuple[float, ...]:
    """Of the line alone: sizes, and shares of symbols, bars, digits, capitals, marks, repeated and distinct words."""
    n = max(len(line), 1)
    words = line.split()
    k = max(len(words), 1)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = sum(map(str.isalpha, line)) if not line.isascii() else sum(c.isalpha() for c in line)
    return (
        min(len(line), 1000) / 1000,
        min(k, 100) / 100,
        min(1.0, 5 * len(SYMBOLS.findall(line)) / n),
        min(1.0, 5 * line.count("|") / n),
        min(1.0, 5 * line.count("!") / n),
        sum(map(str.isupper, line)) / max(letters, 1),
        sum(map(str.isdigit, line)) / n,
        again / k,
        1 - len(set(words)) / k if words else 0.0,
        float(line[-1:] in (".", "!", "?", ":")),
    )


def lines_of(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip()] or [""]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One row per line: own features, then the previous and the next line's, then 1; and the lines' weights."""
    lines = lines_of(text)
    own = np.array([line_features(x) for x in lines])
    none = np.zeros((1, N_FEATURES))
    x = np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), np.ones((len(lines), 1))])
    return x, np.array([max(len(x), 1) for x in lines], float)


@dataclass
class Field:
    """Weights of the good label's evidence and of the four label pairs; curve: slope and middle of the score."""

    weights: np.ndarray
    pairs: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    def marginals(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of all lines of the documents between ``bounds``, in step: P(good), summed pair marginals, log normaliser."""
        evidence = np.stack([np.zeros(len(x)), x @ self.weights], axis=1)
        first, n = bounds[:-1], np.diff(bounds)
        order = np.argsort(-n, kind="stable")
        first, n = first[order], n[order]
        longest = int(n[0]) if len(n) else 0
        alive = np.searchsorted(-n, -np.arange(longest), side="left")  # documents with a line at each step
        forward, backward = np.empty_like(evidence), np.zeros_like(evidence)
        log_z = 0.0
        for t in range(longest):
            at = first[: alive[t]] + t
            forward[at] = evidence[at] if t == 0 else evidence[at] + np.logaddexp.reduce(forward[at - 1][:, :, None] + self.pairs, axis=1)
        for t in range(longest - 2, -1, -1):
            at = first[: alive[t + 1]] + t
            backward[at] = np.logaddexp.reduce(self.pairs + (evidence[at + 1] + backward[at + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(forward + backward, axis=1)
        good = np.exp(forward[:, 1] + backward[:, 1] - z)
        log_z = float(z[first].sum())
        inner = np.ones(len(x), bool)
        inner[bounds[:-1]] = False
        to = np.flatnonzero(inner)
        both = np.exp(forward[to - 1][:, :, None] + self.pairs + (evidence[to] + backward[to])[:, None, :] - z[to][:, None, None])
        return good, both.sum(axis=0), log_z

    def quality(self, x: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, per document."""
        good, _, _ = self.marginals(x, bounds)
        return np.add.reduceat(good * weights, bounds[:-1]) / np.add.reduceat(weights, bounds[:-1])

    def score(self, x: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        slope, middle = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * (self.quality(x, weights, bounds) - middle), -30, 30)))


def fit(x: np.ndarray, weights: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum conditional likelihood by Adam; lines of all documents are walked side by side."""
    n = np.diff(bounds)
    y = np.repeat(labels, n).astype(float)
    inner = np.ones(len(x), bool)
    inner[bounds[:-1]] = False
    to = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to - 1].astype(int), y[to].astype(int)), 1)
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        good, both, _ = field.marginals(x, bounds)
        slope = np.concatenate([x.T @ (y - good), (seen - both).ravel()]) / len(x) - RIDGE * params
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        field = Field(params[:-4], params[-4:].reshape(2, 2))
    q = field.quality(x, weights, bounds)
    good, bad = q[labels == 1], q[labels == 0]
    cuts = np.unique(np.concatenate([[0.0], np.sort(q), [1.0]]))
    middles = (cuts[1:] + cuts[:-1]) / 2
    wrong = np.searchsorted(np.sort(good), middles) / len(good) + 1 - np.searchsorted(np.sort(bad), middles) / len(bad)
    best = np.flatnonzero(wrong == wrong.min())  # of equally good middles, the one in the widest gap
    field.curve = (10.0, float(middles[best[np.argmax(np.diff(cuts)[best])]]))
    return field


FEATURES = "label int, n_lines int, features binary, weights binary"


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on (doc_id, text) and (doc_id, quality), at most ``sample`` documents of each label."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    few = chosen[0].unionByName(chosen[1])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, start, text in zip(*(batch.column(c).to_pylist() for c in ("label", "start", "text")), strict=True):
                lines = lines_of(text)
                start = start % max(1, len(lines) - SAMPLE_LINES + 1)
                x, w = document_features("\n".join(lines[start : start + SAMPLE_LINES]))
                rows.append({"label": label, "n_lines": len(w), "features": x.tobytes(), "weights": w.tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema({"label": pa.int32(), "n_lines": pa.int32(), "features": pa.binary(), "weights": pa.binary()}))

    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("label", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("start"), "text").limit(2 * sample).mapInArrow(featured, FEATURES).collect()  # rows may repeat a doc_id
    y = np.array([r.label for r in rows])
    if len(set(y.tolist())) < 2:
        return Field(np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)), constant=float(y.mean()) if len(y) else 0.5)
    x = np.frombuffer(b"".join(r.features for r in rows)).reshape(-1, 3 * N_FEATURES + 1)
    w = np.frombuffer(b"".join(r.weights for r in rows))
    return fit(x, w, np.cumsum([0, *(r.n_lines for r in rows)]), y)


def score_quality(docs: DataFrame, field: Field, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with ``out``: 0 to 1, higher where label 1 is likelier."""
    kept = docs.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                made = [document_features(t) for t in part.column(text_col).to_pylist()]
                bounds = np.cumsum([0, *(len(w) for _, w in made)])
                score = field.score(np.vstack([x for x, _ in made]), np.concatenate([w for _, w in made]), bounds)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, out])

    return kept.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    field = train(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return score_quality(docs, field).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
