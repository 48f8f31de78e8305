"""Vector and score functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

POWER, EPSILON = 10.0, 1e-12
HALF_LIFE = 10.0
# The weights of answer, question and meta scores by a record's mode.
MODE_WEIGHTS = {"QA": (0.55, 0.35, 0.10), "A": (0.85, 0.0, 0.15), "Q": (0.0, 0.85, 0.15)}


def word_vectors(texts: Column, size: int = 64) -> Column:
    """A vector per text of an array: its words counted by md5 bucket; a deterministic stand-in for a learned encoder."""
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % size
    buckets = F.transform(texts, lambda t: F.transform(F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda w: w != ""), bucket))
    return F.transform(buckets, lambda b: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.size(F.filter(b, lambda x: x == d)).cast("double")))


def centroid(vectors: Column, size: int) -> Column:
    """Mean of an array's vectors; null where there are none."""
    total = lambda vs: F.aggregate(vs, F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return once(vectors, lambda vs: F.when(F.size(vs) > 0, F.transform(total(vs), lambda x: x / F.size(vs))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for null or empty vectors, vectors of different lengths, and zero vectors."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    length = norm(a) * norm(b)
    return F.when(F.coalesce(usable, F.lit(False)) & (length > 0), dot(a, b) / length).otherwise(0.0)


def cosine_eps(a: Column, b: Column) -> Column:
    """Product of vectors that are normalised with a small constant added to their lengths."""
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def power_mean(scores: Column, p: float = POWER) -> Column:
    """An aggregate: power mean of scores, negative ones taken as 0."""
    return F.pow(F.avg(F.pow(F.greatest(scores, F.lit(0.0)), F.lit(p))), F.lit(1.0 / p))


def array_power_mean(scores: Column, p: float = POWER) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.pow(F.greatest(x, F.lit(0.0)), F.lit(p)))
    return F.when(F.size(scores) > 0, F.pow(total / F.size(scores), F.lit(1.0 / p))).otherwise(0.0)


def distance_score(d: Column) -> Column:
    """1 / (1 + d), d at least 0; 0 for null, NaN and infinite distances."""
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(bad, 0.0).otherwise(1.0 / (1.0 + F.greatest(d, F.lit(0.0))))


def recency(k: Column, half_life: float = HALF_LIFE) -> Column:
    """2 ** (-k / h); 1 for null, NaN and infinite k; negative k counts as 0; a half-life that isn't positive as 10."""
    h = half_life if half_life and half_life > 0 else HALF_LIFE
    k = k.cast("double")
    unknown = k.isNull() | F.isnan(k) | (F.abs(k) == float("inf"))
    return F.when(unknown, 1.0).otherwise(F.pow(F.lit(2.0), -F.greatest(k, F.lit(0.0)) / h))


def norm_weights(a: float, b: float) -> tuple[float, float]:
    """Both at least 0 and of sum 1; (1, 0) where nothing is left."""
    a, b = max(a, 0.0), max(b, 0.0)
    return (a / (a + b), b / (a + b)) if a + b > 0 else (1.0, 0.0)


def blended(score: Column, age: Column, tag: Column, weight: float, age_weight: float) -> Column:
    """Score and age blended by weight; Gold records keep their score."""
    w, v = norm_weights(weight, age_weight)
    return F.when(tag == "Gold", score).otherwise(w * score + v * age)


def episodic_score(score: Column, k: Column, tag: Column) -> Column:
    return blended(score, recency(k), tag, 0.75, 0.25)


def chunk_score(score: Column, k: Column, tag: Column) -> Column:
    return blended(score, recency(k), tag, 0.9, 0.1)


def mode_weighted(mode: Column, answer: Column, question: Column, meta: Column) -> Column:
    """Weighted sum by mode; an unknown mode counts as QA."""
    part = lambda m: sum((F.coalesce(c, F.lit(0.0)) * w for c, w in zip((answer, question, meta), MODE_WEIGHTS[m], strict=True)), F.lit(0.0))
    return F.when(mode == "A", part("A")).when(mode == "Q", part("Q")).otherwise(part("QA"))


def top_mean(scores: Column) -> Column:
    """Mean of an array's best scores: of up to 4 all, of up to 20 four, else the best fifth."""
    n = F.size(scores)
    take = F.when(n <= 4, n).when(n <= 20, 4).otherwise(F.greatest(F.lit(1), F.floor(n / 5).cast("int")))
    best = F.slice(F.sort_array(scores, asc=False), 1, F.greatest(take, F.lit(1)))
    return F.when(n > 0, F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / take).otherwise(0.0)


def sparse_clean(weights: Column) -> Column:
    return F.map_filter(weights, lambda k, v: v.isNotNull() & (v != 0))


def sparse_dot(a: Column, b: Column) -> Column:
    """Sum of products over shared terms of two maps."""
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.coalesce(a[k] * b[k], F.lit(0.0)))


def qa_budget(question: Column, answer: Column, total: int, question_most: int) -> tuple[Column, Column]:
    """Token budgets of question and answer, in proportion, rounded half to even; the question's has a limit of its own."""
    share = F.bround(F.lit(float(total)) * question / F.greatest(question + answer, F.lit(1)), 0).cast("int")
    q = F.least(share, F.lit(question_most))
    q = F.when((question > 0) & (q <= 0), min(question_most, total)).otherwise(q)
    return q, F.greatest(F.lit(total) - q, F.lit(0))
