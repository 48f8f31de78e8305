"""An inverted-file index of dense vectors: rows kept by the cell of their nearest centroid, searched a few cells at a time.

Centroids come from k-means whose rounds are grouped aggregations over a bounded sample: each task sums its own rows
by cell before anything is shuffled. Every row is then written under its cell, a partition folder. A search picks the
``probes`` nearest cells of each query vector, and Spark reads those folders alone; metadata filters are pushed into
the same scan. With all cells (``probes=None``) it is exact. How many cells reach a wanted recall is measured when the
index is built, against an exact comparison of a bounded sample of its rows with all rows, and stored with it.

A small request is broadcast to the rows, of which each task returns its best k per query. A large one (its size is
counted) meets the rows cell by cell, its nearest first; cells of more than ``PART_ROWS`` rows are parted, and queries visit all parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON
from ..sources.commits import Change, Store
from .predicates import where

#: Centroids go to all tasks: at most this many, and at most so many numbers in all.
MOST_CELLS, CENTROID_NUMBERS = 4_096, 4_000_000
SAMPLE_ROWS, SAMPLE_NUMBERS, ROUNDS = 100_000, 8_000_000, 6
#: Rows that recall is measured on, for these k, and the recall that is wanted.
MEASURED, DEPTHS, TARGET = 128, (10, 100), 0.95
BROADCAST_QUERIES, PART_ROWS, QUERY_ROWS = 1_000, 50_000, 20_000
#: Scores that a task holds at once.
LOT_NUMBERS = 1_000_000


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt(np.einsum("ij,ij->i", x, x)) + EPSILON)[:, None]


def _nearest(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of every row, nearest first."""
    likeness = _unit(x) @ centers.T
    return np.argsort(-likeness, axis=1, kind="stable")[:, :n]


def fit(vectors: DataFrame, cells: int, vector: str = "vector", rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of a bounded sample, by rounds of spherical k-means."""
    spark = vectors.sparkSession
    start = vectors.orderBy(F.xxhash64(vector)).limit(cells).select(vector).toArrow()
    centers = _unit(_matrix(start[vector]))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(centers)

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(held.value)
            for batch in batches:
                x = _unit(_matrix(batch.column(0)))
                np.add.at(total, _nearest(x, held.value, 1)[:, 0], x)
            cell = np.flatnonzero(np.abs(total).sum(axis=1))
            dims = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cell, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(cell))), pa.array(total[cell].ravel())], names=["cell", "dim", "x"])

        moved = vectors.select(vector).mapInArrow(sums, "cell int, dim int, x double").groupBy("cell", "dim").agg(F.sum("x").alias("x")).toArrow()
        after = np.zeros_like(centers)
        after[moved["cell"].to_numpy(), moved["dim"].to_numpy()] = moved["x"].to_numpy()
        centers = np.where(np.abs(after).sum(axis=1, keepdims=True) > 1e-9, _unit(after), centers)
        held.unpersist()
    return centers


def assigned(vectors: DataFrame, centers: np.ndarray, n: int = 1, vector: str = "vector") -> DataFrame:
    """The rows with their n nearest cells, nearest first."""
    held = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(_matrix(batch.column(vector)), held.value, n).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{fields}, cells array<int>")


def build(vectors: DataFrame, store: Store, name: str, cells: int | None = None, vector: str = "vector") -> None:
    """Write the index of (id, vector, any metadata): its rows by cell, centroids and measured probes, in one commit.

    Rows of a null id or vector are left out.
    """
    rows = vectors.where(F.col("id").isNotNull() & F.col(vector).isNotNull())
    n, dims, least = rows.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0)), F.coalesce(F.min(F.size(vector)), F.lit(0))).head()
    if dims != least:
        raise ValueError("an index holds vectors of one length")
    most = min(MOST_CELLS, max(1, CENTROID_NUMBERS // max(dims, 1)))
    cells = min(cells or max(1, round(n**0.5)), most, max(n, 1))
    sample = rows.select(vector)
    if n > (bound := min(SAMPLE_ROWS, max(cells, SAMPLE_NUMBERS // max(dims, 1)))):
        sample = sample.sample(min(1.0, 1.1 * bound / n), seed=5).limit(bound)
    centers = fit(sample, cells, vector) if n else np.empty((0, 0))
    placed = assigned(rows, centers, 1, vector).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
    spark = rows.sparkSession

    def change(c: Change) -> None:
        c.replace(name, placed.hint("rebalance", "cell"), key="id", partition_by=("cell",))
        c.replace(f"{name}_centroids", spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(centers)], "cell int, centroid array<double>"), key="cell")
        measured = probes_needed(rows, centers, vector) if n else []
        c.replace(f"{name}_probes", spark.createDataFrame(measured, "k int, probes int, recall double"), key="k")

    store.change(change)


def add(store: Store, name: str, vectors: DataFrame, vector: str = "vector") -> None:
    """Put rows in, in place of those with their ids: only these are written, under the centroids that are there."""
    placed = assigned(vectors.where(F.col("id").isNotNull() & F.col(vector).isNotNull()), centroids(store, name), 1, vector)
    store.change(lambda c: c.upsert(name, placed.withColumn("cell", F.get("cells", F.lit(0))).drop("cells")))


def centroids(store: Store, name: str) -> np.ndarray:
    rows = sorted(store.read(f"{name}_centroids").collect())
    return np.array([r.centroid for r in rows]) if rows else np.empty((0, 0))


def probes_needed(rows: DataFrame, centers: np.ndarray, vector: str = "vector", depths: tuple[int, ...] = DEPTHS, target: float = TARGET) -> list[tuple[int, int, float]]:
    """(k, probes, recall): the fewest cells that hold the wanted share of the true k nearest, over a bounded sample of rows, each compared with all."""
    sample = _matrix(rows.orderBy(F.xxhash64("id")).limit(MEASURED).select(vector).toArrow()[vector])
    order = np.argsort(_nearest(sample, centers, len(centers)), axis=1)  # of each sample, a cell's place among its nearest
    asked = rows.sparkSession.sparkContext.broadcast((_unit(sample), centers))
    most = max(depths)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = asked.value
        score, cell = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            for a in range(0, len(x), 5_000):
                part = x[a : a + 5_000]
                score = np.concatenate([score, q @ _unit(part).T], axis=1)
                cell = np.concatenate([cell, np.tile(_nearest(part, own, 1)[:, 0], (len(q), 1))], axis=1)
                keep = np.argsort(-score, axis=1, kind="stable")[:, :most]
                score, cell = np.take_along_axis(score, keep, axis=1), np.take_along_axis(cell, keep, axis=1)
        who = np.repeat(np.arange(len(q)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(cell.ravel()), pa.array(score.ravel())], names=["q", "cell", "score"])

    place = Window.partitionBy("q").orderBy(F.desc("score"), "cell")
    found = rows.select(vector).mapInArrow(best, "q long, cell long, score double").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)
    found = found.select("q", "cell", "rank").toArrow()  # MEASURED times the largest k
    at, rank = order[found["q"].to_numpy(), found["cell"].to_numpy()], found["rank"].to_numpy()
    out = []
    for k in depths:
        places = np.sort(at[rank <= k])
        probes = int(places[max(0, int(np.ceil(target * len(places))) - 1)]) + 1
        out.append((k, probes, float(np.mean(places < probes))))
    return out


def probes_for(store: Store, name: str, k: int) -> int:
    """Measured probes for the least k that isn't smaller; all cells beyond those measured."""
    rows = sorted((r.k, r.probes) for r in store.read(f"{name}_probes").collect())
    return next((p for depth, p in rows if depth >= k), MOST_CELLS)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, equal ones (to twelve decimals) by id."""
    if len(scores) > 4 * k:
        bar = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= bar)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _numbers(column: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, which may be texts."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.unique(np.array(column.to_pylist(), dtype=object), return_inverse=True)[1]


def search(store: Store, name: str, queries: DataFrame, k: int, probes: int | None = None, spec: dict[str, Any] | None = None, vector: str = "vector") -> DataFrame:
    """query_id, rank, id, score (cosine, to twelve decimals): the k nearest rows of each of (query_id, vector), among its ``probes`` nearest cells, or all.

    ``spec`` filters rows by their metadata before any is scored, so k rows that pass are found where there are as many.
    """
    centers = centroids(store, name)
    stored = store.read(name)
    stored = stored.where(where(spec, stored.columns)) if spec else stored
    if not len(centers):
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank long, id {stored.schema['id'].dataType.simpleString()}, score double")
    n = min(probes or len(centers), len(centers))
    asked = assigned(queries.select("query_id", F.col(vector).alias("vector")), centers, n)
    kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((stored, "id"), (queries, "query_id")))
    if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        scored = _small(stored.select("id", "cell", F.col(vector).alias("vector")), asked, k, n < len(centers), f"query_id {query_kind}, id {kind}, score double")
    else:
        scored = _large(stored.select("id", "cell", F.col(vector).alias("vector")), asked, k, f"query_id {query_kind}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _small(stored: DataFrame, asked: DataFrame, k: int, pruned: bool, schema: str) -> DataFrame:
    spark = stored.sparkSession
    held = asked.toArrow()
    if not held.num_rows:
        return spark.createDataFrame([], schema)
    q, cells = _unit(_matrix(held["vector"])), _cells(held["cells"])
    if pruned:
        stored = stored.where(F.col("cell").isin(np.unique(cells).tolist()))
    given = spark.sparkContext.broadcast((held["query_id"].combine_chunks(), q, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, cells = given.value
        kept: list[tuple] = [(None, np.empty(0)) for _ in range(len(q))]
        for batch in batches:
            own = batch.column("cell").to_numpy()
            x = _unit(_matrix(batch.column("vector")))
            for i in range(len(q)):
                at = np.flatnonzero(np.isin(own, cells[i])) if pruned else np.arange(len(own))
                if not len(at):
                    continue
                ids, scores = batch.column("id").take(pa.array(at)), np.round(x[at] @ q[i], 12)
                if kept[i][0] is not None:
                    ids, scores = pa.concat_arrays([kept[i][0], ids]), np.concatenate([kept[i][1], scores])
                best = _best(_numbers(ids), scores, k)
                kept[i] = (ids.take(pa.array(best)), scores[best])
        for i, (ids, scores) in enumerate(kept):
            if ids is not None:
                yield pa.RecordBatch.from_arrays([pa.array([names[i].as_py()] * len(ids), names.type), ids, pa.array(scores)], names=["query_id", "id", "score"])

    return stored.mapInArrow(run, schema)


def _cells(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _large(stored: DataFrame, asked: DataFrame, k: int, schema: str) -> DataFrame:
    """Rows that may be among the k best of each query; the k best are.

    A query first meets the nearest of its cells that together have k rows. The k-th best of these is a bar: of its other
    cells, rows below it aren't given back. So rows out are a few times k a query, however many cells it visits.
    """
    n_rows = {r.cell: r["count"] for r in stored.groupBy("cell").count().collect()}  # cells are at most MOST_CELLS
    if not n_rows:
        return stored.sparkSession.createDataFrame([], schema)
    sizes = F.broadcast(stored.sparkSession.createDataFrame([([n_rows.get(i, 0) for i in range(max(n_rows) + 1)],)], "sizes_ array<long>"))
    size = lambda c: F.coalesce(F.get("sizes_", c), F.lit(0))
    state = lambda cells, rows: F.struct(cells.alias("cells"), rows.alias("rows"))
    near = F.aggregate("cells", state(F.lit(0), F.lit(0).cast("long")), lambda s, c: F.when(s["rows"] < k, state(s["cells"] + 1, s["rows"] + size(c))).otherwise(s), lambda s: s["cells"])
    placed = asked.crossJoin(sizes).withColumn("cells", F.filter("cells", lambda c: size(c) > 0)).withColumn("near_", near)
    visits = lambda cells, *more: placed.select("query_id", "vector", F.explode(cells).alias("cell"), *more)
    first = _met(stored, visits(F.slice("cells", F.lit(1), F.col("near_"))).withColumn("bar", F.lit(float("-inf"))), n_rows, k, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    bars = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("n_")).where(F.col("n_") == k).drop("n_")
    rest = visits(F.slice("cells", F.col("near_") + 1, F.size("cells"))).join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    return first.unionByName(_met(stored, rest, n_rows, k, schema))


def _met(stored: DataFrame, visits: DataFrame, n_rows: dict[int, int], k: int, schema: str) -> DataFrame:
    """Visits (query_id, vector, cell, bar) and the rows of their cells: the k best of each visit that reach the bar."""
    spark = stored.sparkSession
    parts = F.broadcast(spark.createDataFrame([(c, -(-n // PART_ROWS)) for c, n in n_rows.items()], "cell int, n_parts int"))
    blocks = F.broadcast(visits.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("n_blocks")))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = stored.join(parts, "cell").join(blocks, "cell").withColumn("part", spread("id", "n_parts")).withColumn("block", every("n_blocks"))
    visits = visits.join(parts, "cell").join(blocks, "cell").withColumn("block", spread("query_id", "n_blocks")).withColumn("part", every("n_parts"))

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        who, at, value = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if own.num_rows and given.num_rows:
            x, q, bar = _unit(_matrix(own["vector"])), _unit(_matrix(given["vector"])), given["bar"].to_numpy()[:, None]
            numbers = _numbers(own["id"].combine_chunks())
            lot = max(1, LOT_NUMBERS // len(x))
            for a in range(0, len(q), lot):
                scores = np.round(q[a : a + lot] @ x.T, 12)
                least = bar[a : a + lot]
                if len(x) > 4 * k:
                    least = np.maximum(least, -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k])
                i, j = np.nonzero(~(scores < least))
                best = np.lexsort((numbers[j], -scores[i, j], i))
                i, j = i[best], j[best]
                some = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[some], j[some]
                who, at, value = [*who, i + a], [*at, j], [*value, scores[i, j]]
        who, at = pa.array(np.concatenate(who)), pa.array(np.concatenate(at))
        return pa.table([given["query_id"].take(who), own["id"].take(at), pa.array(np.concatenate(value))], names=["query_id", "id", "score"])

    keys = ["cell", "part", "block"]
    return rows.select(*keys, "id", "vector").groupBy(*keys).cogroup(visits.select(*keys, "query_id", "vector", "bar").groupBy(*keys)).applyInArrow(run, schema)
