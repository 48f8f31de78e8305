"""Near-duplicate vectors by robust-pruned flat graphs: built on overlapping cells, united, searched from medoids.

Equal vectors are one node with its number of copies. Centroids are fitted on a bounded sample; every node is a
member of its ``OVERLAP`` nearest cells. In each cell a task builds a graph: nodes are inserted in batches, a
greedy search from the medoid over the graph so far proposes neighbours, robust pruning keeps of them those that
no kept one is closer to by the factor ``ALPHA``, and the links back are pruned alike; what the medoid doesn't
reach gets a link from its nearest reached node. The lists of a node from its cells are united.

Then every node is looked for in its ``PROBES`` nearest cells, over the united lists: a greedy search from the
medoid with a beam, then its range is expanded, following all nodes within reach of the threshold until no new
one is found. Every similarity is computed in double precision from whole vectors, so no link is below the
threshold. A search may miss links: ``audit`` compares a bounded sample of nodes with all nodes exactly, and
while too few of their links were found, beam and cells are doubled and the search is done again.

Links are counted where they are found, never written: a neighbour counts in its nearest cell of those the
searched node visits, so once, and a task passes on each node's count and its class among the links it saw, a
row per node. Classes of all tasks are joined by star contraction. Cells of more than ``SHARD`` members (one group
may hold a third of all) are parted by hash, with a graph for each part; their searches visit all parts, in blocks
of ``QUERIES``, so that memory is bounded and no member is left out. Such a group's links are still counted one by
one, which takes time with the square of its size.

Null and empty vectors, zero vectors, and those with null, NaN or infinite components link with nothing: no links, a
component of their own. Vectors of different lengths aren't linked. Repeated rows are vectors of their own; a null
vec_id gets its class's least id, and isn't kept. Empty tables give empty tables. Extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, scratch, table
from .neardup import components

LEAST = 0.95
CELL, SHARD, QUERIES = 1_500, 6_000, 20_000
OVERLAP, PROBES = 2, 4
DEGREE, BEAM, ALPHA, WIDE, BATCH = 24, 48, 1.2, 4, 256
#: Lists that every node is on, at least, if it has as many neighbours.
FEW = 3
#: Numbers in the sample that centroids are fitted on, and samples to a centroid.
SAMPLE_NUMBERS, PER_CENTROID, ROUNDS = 4_000_000, 6, 8
#: Nodes below the threshold by this much are still followed when a range is expanded.
SLACK = 0.03
AUDITED, TARGET, TRIES = 512, 0.95, 3

#: The same result in DuckDB SQL, by comparing all pairs.
ORACLE_SQL = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, component_id = v.vec_id AS kept FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) l ON l.a = v.vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) r ON r.a = v.vec_id"""


def unit(x: np.ndarray) -> np.ndarray:
    """Rows brought to length 1, in double precision, whatever their scale."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


class Search:
    """Greedy searches of several vectors at once: which nodes each has seen, at what similarity, and expanded.

    Neighbours of node i are flat[at[i]:at[i + 1]], -1 for none.
    """

    def __init__(self, x: np.ndarray, flat: np.ndarray, at: np.ndarray, queries: np.ndarray, start: int):
        self.x, self.flat, self.at, self.queries = x, flat, at, queries
        shape = (len(queries), len(x))
        self.similarity, self.expanded = np.full(shape, -2.0), np.zeros(shape, bool)
        self.similarity[:, start] = queries @ x[start]
        self.start = start

    def expand(self, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Look at the neighbours of these nodes; rows and nodes that weren't seen before."""
        self.expanded[row, node] = True
        n = self.at[node + 1] - self.at[node]
        rows, nodes = np.repeat(row, n), self.flat[np.repeat(self.at[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        new = (nodes >= 0) & (self.similarity[rows, nodes] == -2.0)
        rows, nodes = np.divmod(np.unique(rows[new] * len(self.x) + nodes[new]), len(self.x))
        for a in range(0, len(rows), 50_000):
            r, n = rows[a : a + 50_000], nodes[a : a + 50_000]
            self.similarity[r, n] = np.einsum("ij,ij->i", self.queries[r], self.x[n])
        return rows, nodes

    def beam(self, size: int) -> np.ndarray:
        """The ``size`` nearest nodes that a greedy search meets, nearest first, -1 where there are fewer."""
        best = np.full((len(self.queries), size), -1)
        best[:, 0] = self.start
        while True:
            rows = np.arange(len(best))[:, None]
            waiting = (best >= 0) & ~self.expanded[rows, best]
            row, place = np.nonzero(waiting & (np.cumsum(waiting, axis=1) <= WIDE))
            if not len(row):
                return best
            row, node = self.expand(row, best[row, place])
            n = np.bincount(row, minlength=len(best))
            more = np.full((len(best), int(n.max(initial=0))), -1)
            more[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = node
            best = np.concatenate([best, more], axis=1)
            order = np.argsort(np.where(best >= 0, -self.similarity[rows, best], 3.0), axis=1, kind="stable")[:, :size]
            best = np.take_along_axis(best, order, axis=1)

    def widen(self, least: float) -> None:
        """Follow every node of this similarity or more until no new one is met."""
        while True:
            row, node = np.nonzero((self.similarity >= least) & ~self.expanded)
            if not len(row):
                return
            for a in range(0, len(row), 16_384):
                self.expand(row[a : a + 16_384], node[a : a + 16_384])


def pruned(x: np.ndarray, node: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning: of each node's candidates (-1: none) the nearest, again and again, without those that a chosen one is much nearer to."""
    out = np.full((len(node), degree), -1)
    step = max(1, 4_000_000 // (candidates.shape[1] * x.shape[1] + 1))
    for a in range(0, len(node), step):
        own, of = candidates[a : a + step], node[a : a + step]
        near = x[own]
        similarity = np.einsum("icd,id->ic", near, x[of])
        alive, rows = (own >= 0) & (own != of[:, None]), np.arange(len(own))
        for k in range(degree):
            pick = np.argmax(np.where(alive, similarity, -3.0), axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[a : a + step, k] = np.where(some, own[rows, pick], -1)
            between = np.einsum("icd,id->ic", near, near[rows, pick])
            alive &= ALPHA**2 * (1 - between) > 1 - similarity
            alive[rows, pick] = False
            alive &= own != own[rows, pick][:, None]
    return out


def built(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> tuple[list[np.ndarray], int]:
    """Neighbours of every row of x (unit vectors), and the medoid."""
    n = len(x)
    start = int(np.argmax(x @ x.sum(axis=0)))
    order = np.random.default_rng(13).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    lists = np.full((n, degree), -1)
    first = order[: 2 * degree]
    lists[first] = pruned(x, first, np.tile(first, (len(first), 1)), degree)
    at = len(first)
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        found = Search(x, lists.ravel(), np.arange(n + 1) * degree, x[batch], start).beam(beam)
        mates = x[batch] @ x[batch].T
        near = batch[np.argsort(-mates, axis=1, kind="stable")[:, 1 : 1 + degree // 2]]
        lists[batch] = pruned(x, batch, np.concatenate([found, near], axis=1), degree)
        _link_back(x, lists, batch)
        at += len(batch)
    return _reached(x, _met_often(x, [row[row >= 0] for row in lists]), start), start


def _met_often(x: np.ndarray, lists: list[np.ndarray]) -> list[np.ndarray]:
    """The lists, in which every node that is on few has its nearest neighbours link back to it: in a tight group such nodes would be missed."""
    few = np.flatnonzero(np.bincount(np.concatenate(lists), minlength=len(x)) < FEW)
    nearest = [(u, lists[u][np.argsort(-(x[lists[u]] @ x[u]), kind="stable")[:FEW]]) for u in few.tolist()]
    for u, near in nearest:
        for w in near.tolist():
            lists[w] = np.append(lists[w], u)
    return lists


def _link_back(x: np.ndarray, lists: np.ndarray, batch: np.ndarray) -> None:
    to, at = lists[batch].ravel(), np.repeat(batch, lists.shape[1])
    at, to = at[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    at, to = at[order], to[order]
    nodes, head, n = np.unique(to, return_index=True, return_counts=True)
    by = np.argsort(n, kind="stable")
    for part in np.array_split(by, max(1, len(by) // 256)):  # alike numbers of new links together
        widest = int(n[part].max(initial=0))
        more = np.where(np.arange(widest) < n[part][:, None], at[np.minimum(head[part][:, None] + np.arange(widest), len(at) - 1)], -1)
        lists[nodes[part]] = pruned(x, nodes[part], np.concatenate([lists[nodes[part]], more], axis=1), lists.shape[1])


def _reached(x: np.ndarray, lists: list[np.ndarray], start: int) -> list[np.ndarray]:
    """The lists with a link to each part that the start didn't lead to, from the nearest node that it leads to."""
    met = np.zeros(len(x), bool)

    def walk(front: list[int]) -> None:
        met[front] = True
        while front:
            near = np.unique(np.concatenate([lists[i] for i in front]))
            front = near[~met[near]].tolist()
            met[front] = True

    walk([start])
    while not met.all():
        out, inside = np.flatnonzero(~met)[:1_000], np.flatnonzero(met)
        near = x[out] @ x[inside].T
        i, j = np.divmod(int(np.argmax(near)), len(inside))
        lists[inside[j]] = np.append(lists[inside[j]], out[i])
        walk([int(out[i])])
    return lists


class Classes:
    """Least member of each class of linked numbers, pairs coming in lots."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        while len(a):
            some = a != b
            a, b = np.divmod(np.unique(np.maximum(a, b)[some] * len(self.label) + np.minimum(a, b)[some]), len(self.label))
            np.minimum.at(self.label, a, b)
            while not np.array_equal(self.label, further := self.label[self.label]):
                self.label = further
            a, b = self.label[a], self.label[b]


def usable(v: Column) -> Column:
    """Of finite components, not all of them zero."""
    return F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))


def fitted(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Centroids for each length of vectors; fitted on a bounded sample, by a few rounds of spherical k-means."""
    out = {}
    for size, n in sorted(map(tuple, nodes.groupBy(F.size("v")).count().collect())):
        most = max(PER_CENTROID, SAMPLE_NUMBERS // size)
        drawn = nodes.where(F.size("v") == size).select("v")
        sample = drawn.sample(min(1.0, 1.1 * most / n), seed=13).limit(most).toArrow() if n > most else drawn.toArrow()
        x = matrix(sample["v"].combine_chunks(), size)
        k = max(1, min(-(-n // CELL), len(x) // PER_CENTROID))
        centers = x[np.random.default_rng(13).choice(len(x), k, replace=False)]
        for _ in range(ROUNDS if k > 1 else 0):
            nearest = np.concatenate([np.argmax(x[a : a + 1_000] @ centers.T, axis=1) for a in range(0, len(x), 1_000)])
            order = np.argsort(nearest, kind="stable")
            held, head = np.unique(nearest[order], return_index=True)
            sums = np.add.reduceat(x[order], head, axis=0)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centers[held] = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centers[held])
        out[size] = centers
    return out


def routed(nodes: DataFrame, centers, probes: int) -> DataFrame:
    """node, v, copies and its nearest cells, nearest first; centers: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = pa.compute.list_value_length(column).to_numpy()
            cells = [None] * batch.num_rows
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                own = centers.value.get(size, np.zeros((1, size)))
                near = np.argsort(-(matrix(column.take(pa.array(at)), size) @ own.T), axis=1, kind="stable")[:, :probes]
                for i, row in zip(at.tolist(), (near + (size << 32)).tolist(), strict=True):
                    cells[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("node"), column, batch.column("copies"), pa.array(cells, pa.list_(pa.int64()))], names=["node", "v", "copies", "cells"])

    kind = nodes.schema["v"].dataType.simpleString()
    return nodes.select("node", "v", "copies").mapInArrow(run, f"node long, v {kind}, copies long, cells array<long>")


def graph(members: DataFrame) -> DataFrame:
    """node and its united list of neighbours, of graphs built for every cell and part."""

    def run(group: pa.Table) -> pa.Table:
        v, ids = group["v"].combine_chunks(), group["node"].to_numpy()
        lists, _ = built(matrix(v, len(v[0])))
        near = pa.array([ids[x] for x in lists], pa.list_(pa.int64()))
        return pa.table([pa.array(ids), near], names=["node", "near"])

    lists = members.groupBy("cell", "part").applyInArrow(run, "node long, near array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a list per cell, at most OVERLAP


def searched(members: DataFrame, queries: DataFrame, least: float, beam: int) -> DataFrame:
    """node, found (copies linked that count in this cell) and root (of its class among the links seen), a row per node and task.

    members: cell, part, block, node, v, copies, first (its nearest cell), near. queries: cell, part, block, node, v, cells.
    """

    def run(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["node", "found", "root"])
        cell, ids = key[0].as_py(), own["node"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        v = own["v"].combine_chunks()
        size = len(v[0])
        x, copies, first = matrix(v, size)[order], own["copies"].to_numpy()[order], own["first"].to_numpy()[order]
        start = int(np.argmax(x @ x.sum(axis=0)))
        near = own["near"].combine_chunks()
        to, n = near.flatten().to_numpy(), pa.compute.list_value_length(near).to_numpy()
        place = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        row, here = np.repeat(np.arange(len(n)), n), ids[place] == to
        row, place = np.argsort(order)[row[here]], place[here]
        by_row = np.argsort(row, kind="stable")
        flat, at = place[by_row], np.searchsorted(row[by_row], np.arange(len(ids) + 1))
        who = asked["node"].to_numpy()
        everyone = np.union1d(ids, who)
        as_member, as_query = np.searchsorted(everyone, ids), np.searchsorted(everyone, who)
        found, classes = np.zeros(len(everyone), np.int64), Classes(len(everyone))
        y, cells = matrix(asked["v"].combine_chunks(), size), asked["cells"].combine_chunks()
        n_cells = pa.compute.list_value_length(cells).to_numpy()
        visited = np.full((len(who), int(n_cells.max())), -1)
        visited[np.repeat(np.arange(len(who)), n_cells), np.arange(n_cells.sum()) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells)] = cells.flatten().to_numpy()
        for a in range(0, len(who), BATCH):
            search = Search(x, flat, at, y[a : a + BATCH], start)
            search.beam(beam)
            search.widen(least - SLACK)
            q, u = np.nonzero(search.similarity >= least)
            other = who[a + q] != ids[u]
            q, u = q[other], u[other]
            mine = (first[u] == cell) | ~(visited[a + q] == first[u][:, None]).any(axis=1)
            np.add.at(found, as_query[a + q[mine]], copies[u[mine]])
            classes.add(as_query[a + q], as_member[u])
        some = (found > 0) | (classes.label != np.arange(len(everyone)))
        return pa.table([pa.array(everyone[some]), pa.array(found[some]), pa.array(everyone[classes.label[some]])], names=["node", "found", "root"])

    keys = ["cell", "part", "block"]
    return members.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "node long, found long, root long")


def audit(nodes: DataFrame, found: DataFrame, least: float) -> float:
    """Share of the links of a bounded sample of nodes that were found, against a comparison with all nodes."""
    spark = nodes.sparkSession
    drawn = nodes.orderBy(F.xxhash64("node")).limit(AUDITED).select("node", "v").toArrow()
    ids, by_size = drawn["node"].to_numpy(), {}
    sizes = pa.compute.list_value_length(drawn["v"].combine_chunks()).to_numpy()
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        by_size[size] = (ids[at], matrix(drawn["v"].combine_chunks().take(pa.array(at)), size))
    sample = spark.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = pa.compute.list_value_length(column).to_numpy()
            for size, (who, x) in sample.value.items():
                at = np.flatnonzero(sizes == size)
                if len(at):
                    near = x @ matrix(column.take(pa.array(at)), size).T >= least
                    near &= who[:, None] != batch.column("node").to_numpy()[at]
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(near @ batch.column("copies").to_numpy()[at])], names=["node", "exact"])

    exact = nodes.select("node", "v", "copies").mapInArrow(run, "node long, exact long").groupBy("node").agg(F.sum("exact").alias("exact"))
    total, met = exact.join(found, "node", "left").agg(F.sum("exact"), F.sum(F.least("exact", F.coalesce("found", F.lit(0))))).head()
    return met / total if total else 1.0


def linked(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).withColumn("usable_", usable(F.col("v")))
    keyed = rows.where("usable_").select("vec_id", "v", F.xxhash64("v").alias("key"), F.xxhash64(F.lit(1), "v").alias("check"))
    one = keyed.groupBy("key", "check").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = scratch(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
    centers = spark.sparkContext.broadcast(fitted(nodes))
    member = routed(nodes, centers, OVERLAP).select("node", "v", "copies", F.get("cells", F.lit(0)).alias("first"), F.explode("cells").alias("cell"))
    member = scratch(member, "members")
    parts = {r[0]: -(-r[1] // SHARD) for r in member.groupBy("cell").count().where(F.col("count") > SHARD).collect()}  # one row per cell at most
    n_parts = _looked_up(parts)
    parted = member.withColumn("part", F.pmod(F.xxhash64("node"), n_parts).cast("int"))
    lists = scratch(graph(parted), "graph")
    placed = scratch(parted.join(lists, "node"), "placed")
    drop(member, lists)
    probes, beam = PROBES, BEAM
    for attempt in range(TRIES):
        asked = scratch(routed(nodes, centers, probes), "asked")
        visits = asked.select("node", "v", "cells", F.explode("cells").alias("cell"))
        blocks = {r[0]: -(-r[1] // QUERIES) for r in visits.groupBy("cell").count().where(F.col("count") > QUERIES).collect()}
        n_blocks = _looked_up(blocks)
        members = placed.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        queries = visits.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), n_blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
        seen = scratch(searched(members, queries, least, beam), "seen")
        found = seen.groupBy("node").agg(F.sum("found").alias("found"))
        drop(asked)
        if attempt + 1 == TRIES or audit(nodes, found, least) >= TARGET:
            break
        drop(seen)
        probes, beam = 2 * probes, 2 * beam
    drop(placed)
    roots = components(seen.select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = nodes.drop("v").join(found, "node", "left").join(roots.withColumnRenamed("key", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_ids = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = whole.join(least_ids, "root").select("key", "check", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), "component_id")
    joined = keyed.select("vec_id", "key", "check").join(whole, ["key", "check"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable_")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _looked_up(numbers: dict[int, int]) -> Column:
    """The number of a row's cell, 1 for cells without one."""
    if not numbers:
        return F.lit(1)
    known = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.col("cell")), F.lit(1))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
