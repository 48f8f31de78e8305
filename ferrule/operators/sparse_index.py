"""A stored inverted index of sparse vectors: posting blocks in order of weight, read by term and only as far as a top k needs.

Each task cuts the postings of its own rows, ``HOT`` at a time: a term's, heaviest first, into blocks of ``BLOCK``. A
block says its greatest weight, and for each metadata column given to the index which values its rows have. Blocks are
written under buckets of terms, sorted, so a request reads the row groups of its own terms. Postings aren't shuffled,
and no term's meet in one task; rows that differ in their metadata are kept apart, so that a filter skips whole blocks.

A search reads the blocks whose greatest weight can still matter at a level, and adds up what it has. What a
document may still gain from blocks not read is bounded by their greatest weights. Once a document that was not met
can't reach the k-th best, only documents whose bound reaches it stay, and their scores are completed; else the
level falls. The result is that of scoring everything. Vectors with negative weights have no such bounds: then
everything is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..sources.commits import Store
from .retrieval import POWER, ranked

BLOCK, BUCKETS, PARTS = 512, 32, 8
#: Postings that a task sorts and cuts at once; a term with more has further blocks.
HOT = 1_048_576
#: Values of a metadata column that a block lists; blocks with more aren't skipped by it.
VALUES = 16
#: Levels, as shares of the greatest product of weights.
LEVELS = (0.6, 0.35)
#: Share of the blocks beyond which a level isn't tried.
SHARE = 0.5
#: A request's distinct (piece, term) pairs; more are no request, but a join of whole tables.
MOST_ASKED = 100_000
#: Terms that are written into the scan's filter; more are joined.
MOST_LISTED = 2_000
BROADCAST_IDS = 100_000
#: Sums in another order differ by less.
SLACK = 1e-9


def build(terms: DataFrame, store: Store, name: str, by: tuple[str, ...] = ()) -> None:
    """Write the index of (id, term, weight) and metadata columns ``by``, whose values are as in every row of their id.

    Null and zero weights are dropped, as are null terms and ids; of a repeated (id, term) all weights count.
    """
    rows = terms.where(F.col("id").isNotNull() & F.col("term").isNotNull() & (F.coalesce("weight", F.lit(0.0)) != 0)).select("id", "term", F.col("weight").cast("double").alias("weight"), *by)
    part = F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int") if by else F.lit(0)
    laid = rows.select(_bucket(F.col("term")).alias("bucket"), "term", part.alias("part"), F.struct((-F.col("weight")).alias("minus"), "id", *by).alias("posting"))
    kinds = {f.name: f.dataType.simpleString() for f in laid.schema}
    blocks = laid.mapInArrow(_cut(BLOCK, HOT), f"bucket int, term {kinds['term']}, postings array<{kinds['posting']}>")
    weights = F.transform("postings", lambda p: -p["minus"])
    listed = lambda c: F.array_sort(F.filter(F.array_distinct(F.transform("postings", lambda p: p[c])), lambda x: x.isNotNull()))
    values = [once(listed(c), lambda v: F.when(F.size(v) <= VALUES, v)).alias(f"{c}_values") for c in by]
    out = blocks.select("bucket", "term", F.array_max(weights).alias("greatest"), F.array_min(weights).alias("least"), *values, "postings")
    written = out.sortWithinPartitions("bucket", "term", F.desc("greatest"))
    store.change(lambda c: c.replace(name, written, key="term", partition_by=("bucket",)))


def _cut(block: int, lot: int):
    """Blocks of a task's postings (bucket, term, part, posting), a lot at a time."""

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        term, part = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["part"].to_numpy()
        posting = rows["posting"].combine_chunks()
        order = np.lexsort((posting.field("minus").to_numpy(), part, term))
        term, part = term[order], part[order]
        fresh = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[fresh, len(order)])
        starts = np.concatenate([np.arange(a, a + n, block) for a, n in zip(fresh, size, strict=True)])
        ends = np.r_[starts, len(order)]
        for a in range(0, len(starts), 64):  # as many blocks a batch
            own, first = ends[a : a + 65], pa.array(order[starts[a : a + 64]])
            lists = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), posting.take(pa.array(order[own[0] : own[-1]])))
            yield pa.RecordBatch.from_arrays([rows["bucket"].combine_chunks().take(first), rows["term"].combine_chunks().take(first), lists], names=["bucket", "term", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, lot):
                held.append(batch.slice(a, lot))
                n += held[-1].num_rows
                if n >= lot:
                    yield from blocks(held)
                    held, n = [], 0
        if n:
            yield from blocks(held)

    return run


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _matching(blocks: DataFrame, spec: dict[str, Any]) -> tuple[DataFrame, Column]:
    """Blocks that may hold rows which pass an equality filter, and the test of a posting ``p``. A column the index doesn't have matches nothing."""
    test = F.lit(True)
    for c, value in spec.items():
        if c.startswith("$"):
            raise ValueError(f"an index filters by equalities, not by {c}")
        if value is None:
            continue
        if f"{c}_values" not in blocks.columns:
            return blocks.limit(0), F.lit(False)
        blocks = blocks.where(F.col(f"{c}_values").isNull() | F.array_contains(f"{c}_values", F.lit(value)))
        test = test & F.col(f"p.{c}").eqNullSafe(F.lit(value))
    return blocks, test


class Request:
    """Terms asked for, by piece, and the blocks that hold them."""

    def __init__(self, store: Store, name: str, query: DataFrame, spec: dict[str, Any] | None = None):
        self.spark = query.sparkSession
        weight = F.sum(F.col("weight").cast("double")).alias("weight")
        found = query.groupBy("piece", "term", _bucket(F.col("term")).alias("bucket")).agg(weight).limit(MOST_ASKED + 1).collect()
        if len(found) > MOST_ASKED:
            raise ValueError("too many terms for one request")
        self.n_pieces = len({r.piece for r in found})
        found = [r for r in found if r.term is not None and r.weight]
        self.asked = [(r.piece, r.term, r.weight) for r in found]
        kinds = {f.name: f.dataType.simpleString() for f in query.schema}
        self.frame = F.broadcast(self.spark.createDataFrame(self.asked, f"piece {kinds['piece']}, term {kinds['term']}, asked double"))
        terms, buckets = sorted({r.term for r in found}), sorted({r.bucket for r in found})
        whole = store.read(name).where(F.col("bucket").isin(buckets))
        if len(terms) <= MOST_LISTED:
            whole = whole.where(F.col("term").isin(terms))
        else:
            whole = whole.join(self.frame.select("term").distinct(), "term", "left_semi")
        self.blocks, self.test = _matching(whole, spec or {})

    def heads(self) -> list[tuple[Any, float, float, int]]:
        """(term, greatest, least, number) of the asked terms' blocks, grouped; their postings aren't read."""
        return [tuple(r) for r in self.blocks.groupBy("term", "greatest").agg(F.min("least").alias("least"), F.count("*").alias("n")).select("term", "greatest", "least", "n").collect()]

    def sums(self, bars: dict[Any, float] | None = None, only: DataFrame | None = None) -> DataFrame:
        """id, piece, dot: of all blocks, or of those with a greatest weight of a term's bar or more; of given ids only."""
        blocks = self.blocks
        if bars is not None:
            kind = blocks.schema["term"].dataType.simpleString()
            blocks = blocks.join(F.broadcast(self.spark.createDataFrame(list(bars.items()), f"term {kind}, bar_ double")), "term").where("greatest >= bar_")
        rows = blocks.select("term", F.explode("postings").alias("p")).where(self.test).select("term", F.col("p.id").alias("id"), (-F.col("p.minus")).alias("weight"))
        if only is not None:
            rows = rows.join(only, "id", "left_semi")
        return rows.join(self.frame, "term").groupBy("id", "piece").agg(F.sum(F.col("weight") * F.col("asked")).alias("dot"))

    def mean(self, total: Column) -> Column:
        return F.pow(total / F.lit(float(max(self.n_pieces, 1))), F.lit(1.0 / POWER))

    def exact(self, dots: DataFrame) -> DataFrame:
        powers = dots.groupBy("id").agg(F.sum(F.pow(F.greatest("dot", F.lit(0.0)), F.lit(POWER))).alias("total"))
        return powers.select("id", self.mean(F.col("total")).alias("score"))


def scores(store: Store, name: str, query: DataFrame, spec: dict[str, Any] | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """id, score of every document (or candidate) that shares a term with (piece, term, weight): power mean of the pieces' dot products."""
    request = Request(store, name, query, spec)
    only = candidates.select("id").distinct() if candidates is not None else None
    return request.exact(request.sums(only=only))


def search(store: Store, name: str, query: DataFrame, k: int, spec: dict[str, Any] | None = None, decimals: int = 6) -> DataFrame:
    """id, score, rank of the k best by score (rounded), then id; the same rows as scoring all, read as far as needed."""
    request = Request(store, name, query, spec)
    rounded = lambda df: ranked(df.withColumn("score", F.round("score", decimals)), k)
    heads = request.heads()
    best: dict[Any, float] = {}
    for term, greatest, _, _ in heads:
        best[term] = max(best.get(term, 0.0), greatest)
    if any(least < 0 for _, _, least, _ in heads) or any(w < 0 for _, _, w in request.asked):
        return rounded(request.exact(request.sums()))
    most = max((w * best.get(t, 0.0) for _, t, w in request.asked), default=0.0)
    weight: dict[Any, float] = {}
    for _, t, w in request.asked:
        weight[t] = max(weight.get(t, 0.0), w)
    for level in LEVELS:
        bars = {t: level * most / weight[t] for t in best}
        rest = dict.fromkeys(best, 0.0)
        for t, g, _, _ in heads:
            if g < bars[t]:
                rest[t] = max(rest[t], g)
        if sum(n for t, g, _, n in heads if g >= bars[t]) > SHARE * sum(n for *_, n in heads):
            break  # little would be left unread
        tails: dict[Any, float] = {}
        for p, t, w in request.asked:
            tails[p] = tails.get(p, 0.0) + w * rest.get(t, 0.0)
        unmet = sum(v**POWER for v in tails.values())
        if candidates := _open(request, bars, tails, unmet, k, 10.0**-decimals):
            return rounded(request.exact(request.sums(only=candidates[0])))
    return rounded(request.exact(request.sums()))


def _open(request: Request, bars: dict, tails: dict, unmet: float, k: int, unit: float) -> tuple[DataFrame] | None:
    """Ids that may still be among the best k; None while a document not met so far may be."""
    tail = F.coalesce(F.create_map(*(F.lit(x) for pair in tails.items() for x in pair))[F.col("piece")], F.lit(0.0))
    power = lambda c: F.pow(c, F.lit(POWER))
    met = request.sums(bars).groupBy("id").agg(F.sum(power(F.col("dot"))).alias("low"), F.sum(power(F.col("dot") + tail) - power(tail)).alias("more"))
    bounded = met.select("id", request.mean(F.col("low")).alias("low"), request.mean(F.col("more") + unmet).alias("high"))
    sure = [r[0] for r in bounded.orderBy(F.desc("low")).limit(k).select("low").collect()]
    bar = sure[-1] - unit - SLACK if len(sure) == k else float("-inf")  # scores that round alike are ordered by id
    if (unmet / max(request.n_pieces, 1)) ** (1.0 / POWER) >= bar:
        return None
    left = bounded.where(F.col("high") >= bar).select("id")
    few = [r[0] for r in left.limit(BROADCAST_IDS + 1).collect()]
    if len(few) > BROADCAST_IDS:
        return (left,)
    kind = left.schema["id"].dataType.simpleString()
    return (F.broadcast(request.spark.createDataFrame([(i,) for i in few], f"id {kind}")),)
