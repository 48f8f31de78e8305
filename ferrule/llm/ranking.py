"""Ranked lexical search: impact-ordered postings, processed score at a time.

The weight of a term in a document is an integer, its impact, which follows from counts over all documents. A
shard is a run of documents of one task: per term its postings are grouped by exact impact, greatest first. A
request's groups are taken in descending impact, those between two levels together, and added to one accumulator
per document. What a document may still gain is at most the sum of the next impacts of the request's terms; once
no more than ``OPEN`` documents can still reach the k-th best score (of this shard so far, or of the task's
shards before it), the top k are among these, and only their scores are completed, from the shard's own list of
each document's impacts. Documents that reach the k-th score exactly stay open, so ties are whole.

Documents aren't shuffled: one pass writes each document's length and its counts of the items' terms, and a task
returns its k best documents per item; these alone meet. Items go to the documents in blocks of about
``BLOCK_CHARS`` characters, a broadcast each, so their number has no bound. A shard ends at ``SHARD_DOCS``
documents or ``SHARD_POSTINGS`` postings; documents of a common term are simply long lists, never one group.
Terms are compared by 64-bit hashes.

Null and empty texts have no terms: such documents count for nothing and are never found, such items find
nothing. Every row is a document or an item of its own, also where ids repeat; rows of a null doc_id come after
others of the same score. Empty tables are fine on either side. Extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, scratch, slices, table, texts
from .wordhash import word_hashes

TOP = 10
BLOCK_CHARS = 4_000_000
SHARD_DOCS, SHARD_POSTINGS = 32_768, 4_000_000
#: Documents whose scores are completed once they are all that can still be among the best.
OPEN = 64
#: Next level of impacts, as a share of the greatest one left.
LEVEL = 0.7
LAST = np.iinfo(np.int64).max

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same result in DuckDB SQL, by scoring every document.
ORACLE_SQL = f"""WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


class Request:
    """A block of items: their distinct terms, as places in the block's sorted vocabulary."""

    def __init__(self, item_texts: list[str | None]):
        hashes, offsets = word_hashes(item_texts)
        self.vocabulary, place = np.unique(hashes, return_inverse=True)
        self.terms = [np.unique(place[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of these words in the vocabulary, -1 for others."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


class Shard:
    """Impact-ordered postings of a run of documents, and their impacts document by document."""

    def __init__(self, size: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        some = impact > 0
        self.size, self.own_term, self.own_impact = size, term[some], impact[some]
        self.own_at = np.searchsorted(doc[some], np.arange(size + 1))
        order = np.lexsort((-self.own_impact, self.own_term))
        self.doc, self.down = doc[some][order], -self.own_impact[order]
        self.at = np.searchsorted(self.own_term[order], np.arange(n_terms + 1))

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores; all with a score of ``least`` or more that are among the best k (ties included), and maybe others."""
        at, end = self.at[terms].copy(), self.at[terms + 1]
        total = np.zeros(self.size, np.int64)
        while True:
            heads = np.where(at < end, -self.down[np.minimum(at, max(len(self.down) - 1, 0))], 0) if len(self.down) else np.zeros(len(terms), np.int64)
            rest = int(heads.sum())
            bar = max(least, int(np.partition(total, -k)[-k]) if self.size >= k else 0, 1)
            if not rest:
                found = np.flatnonzero(total >= bar)
                return found, total[found]
            if rest < bar:  # documents not met so far can't be among the best
                near = np.flatnonzero(total >= bar - rest)
                if len(near) <= OPEN:
                    return near, self.complete(near, terms)
            level = -int(heads.max() * LEVEL)
            for i in np.flatnonzero(-heads <= level).tolist():
                a, b = at[i], end[i]
                stop = a + np.searchsorted(self.down[a:b], level, side="right")  # whole groups of equal impact
                total[self.doc[a:stop]] -= self.down[a:stop]  # a document has one posting of a term
                at[i] = stop

    def complete(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        sizes = self.own_at[docs + 1] - self.own_at[docs]
        rows = np.repeat(self.own_at[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        counted = np.isin(self.own_term[rows], terms)
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), sizes)[counted], self.own_impact[rows][counted])
        return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def counted(docs: DataFrame, request) -> DataFrame:
    """doc_id, n (its terms, with repeats) and the request's terms in it with their counts, written once; request: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = word_hashes(part.column("text").to_pylist())
                place = request.value.places(hashes)
                known = place >= 0
                v = max(len(request.value.vocabulary), 1)
                pairs, tf = np.unique(np.repeat(np.arange(part.num_rows), np.diff(offsets))[known] * v + place[known], return_counts=True)
                at = pa.array(np.searchsorted(pairs // v, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (pairs % v, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tf"])

    return scratch(docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>"), "counted")


def weights(rows: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """Of each term of a block: floor(1000 ln((2N + 2) / (2 df + 1))); counts are summed by each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    if size:
        found = rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        out[found["term"].to_numpy()] = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * found["df"].to_numpy() + 1))).astype(np.int64)
    return out


def _scored(rows: DataFrame, request, weight, n_docs: int, n_words: int, k: int) -> DataFrame:
    """no (of the item in its block), doc_id, score: each task's k best documents per item."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Shard]]:
        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column("terms").flatten())
            if postings >= SHARD_POSTINGS or sum(b.num_rows for b in held) >= SHARD_DOCS:
                yield _shard(pa.Table.from_batches(held))
                held, postings = [], 0
        if held:
            yield _shard(pa.Table.from_batches(held))

    def _shard(held: pa.Table) -> tuple[np.ndarray, Shard]:
        held = held.combine_chunks()
        flat = lambda c: held[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pa.compute.list_value_length(held["terms"]).to_numpy()
        doc, term, tf = np.repeat(np.arange(held.num_rows), sizes), flat("terms"), flat("tf")
        length = 10 + (90 * held["n"].to_numpy() * n_docs) // max(n_words, 1)
        impact = weight.value[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[doc]))
        ids = held["doc_id"].combine_chunks().fill_null(LAST).to_numpy()
        return ids, Shard(held.num_rows, doc, term, impact, len(weight.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in request.value.terms]
        for ids, shard in shards(batches):
            for no, terms in enumerate(request.value.terms):
                known, scores = best[no]
                docs, more = shard.best(terms, k, int(scores[-1]) if len(scores) == k else 0)
                best[no] = _best(np.concatenate([known, ids[docs]]), np.concatenate([scores, more]), k)
        ids, scores = (np.concatenate([b[i] for b in best]) if best else np.empty(0, np.int64) for i in (0, 1))
        no = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        some = scores > 0
        doc_ids = pa.array(ids[some], mask=ids[some] == LAST)
        yield pa.RecordBatch.from_arrays([pa.array(no[some].astype(np.int64)), doc_ids, pa.array(scores[some])], names=["no", "doc_id", "score"])

    return rows.mapInArrow(run, "no long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) for every item (item_id, text), those with a score above 0."""
    spark = docs.sparkSession
    chars = items.agg(F.sum(F.length("text"))).head()[0] or 0
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-chars // BLOCK_CHARS) or 1))
    out = None
    for b in range(-(-chars // BLOCK_CHARS) or 1):
        asked = sorted(((r[0], r[1]) for r in items.where(block == b).select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        request = spark.sparkContext.broadcast(Request([t for _, t in asked]))
        rows = counted(docs, request)
        n_docs, n_words = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).head()
        weight = spark.sparkContext.broadcast(weights(rows, n_docs, len(request.value.vocabulary)))
        found = _scored(rows, request, weight, n_docs, n_words, k)
        order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = scratch(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
        drop(rows)
        names = spark.createDataFrame([(no, i) for no, (i, _) in enumerate(asked)], "no long, item_id long")
        one = found.join(names, "no").select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark").select("item_id", "text"))
