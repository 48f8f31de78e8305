"""Phrase collocations from depth-limited count tries, merged by prefix range.

A shard is a run of texts. Its trie holds every path of a language and up to five words that begins at a word of
a piece; a node's count is how often its words stand there, so the node of a language counts all its words. The
trie is never linked: sorting the paths of all positions gives its nodes in order (a node is a row that differs
from the row before within its first words), and that order, as depth, last word and count, is its serial form.
It is cut at the bounds of prefix ranges, paths drawn from a bounded sample of positions, so that a range has
about ``RANGE_CHARS`` characters' worth of nodes also where one word or pair begins a large part of all paths:
bounds then lie below that pair. A cut carries the ancestors of its first node, with no count of their own.

A task merges the sorted parts of one range from all shards and adds up equal paths. Nodes counted 100 times or
more are kept; as no phrase is more frequent than its parts, all parts of a kept phrase are kept, too. Walking
the merged nodes in order gives each its ancestors' counts, the left parts of its cuts; ancestors that belong to
the range before are looked up. Right parts are found by suffix links, a path without its first words: an
equi-join of the kept nodes with themselves. Scores are exact decimals.

The sample only places bounds: results don't depend on it. At most ``MOST_RANGES`` ranges are made, so what goes
to all tasks is under 2 MB; corpora beyond ``MOST_RANGES`` times ``RANGE_CHARS`` get larger ranges, which need more
memory each. No key is met whole in one task but the few kept paths of a language that are ranked, and of these
each task passes on its first 2,000 only.

A null text has no words; a null lang is ``und``. Repeated rows count as often as they are there. An empty table
gives none. Extra columns are left behind. A text's words must fit into a task's memory some fifty times over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, slices, table
from .wordhash import LOWER

MOST, LEAST, FIRST = 5, 100, 2000
SHARD_BYTES, RANGE_CHARS, MOST_RANGES = 4_000_000, 4_000_000, 20_000
#: Documents and positions that bounds are drawn from, about.
SAMPLE_DOCS, SAMPLE_PATHS = 4_000, 60_000

BREAK = np.zeros(256, bool)
BREAK[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True

#: The same result in DuckDB SQL, by counting phrases as strings.
_PARTS = " UNION ALL ".join(f"SELECT lang, {k} AS size, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS phrase FROM pos WHERE i + {k - 1} <= len(w)" for k in range(1, MOST + 1))
ORACLE_SQL = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces), pos AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM worded),
total AS (SELECT lang, count(*) AS n FROM pos GROUP BY 1), f AS (SELECT lang, size, phrase, count(*) AS a FROM ({_PARTS}) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2), cut AS (SELECT *, unnest(range(1, size)) AS k FROM c),
scored AS (SELECT cut.lang, cut.phrase, cut.size, cut.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * cut.a * n) // (l.a::HUGEINT * r.a) AS score FROM cut
JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(list_slice(w, 1, k), ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(list_slice(w, k + 1, cut.size), ' ') JOIN total ON total.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[1:-2], ' ') AS phrase, a FROM c UNION SELECT lang, array_to_string(w[2:], ' '), a FROM c)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE (lang, phrase, a) NOT IN (SELECT (lang, phrase, a) FROM inside)) WHERE rank <= 2000"""


def paths(texts: list[str | None], langs: list[str | None]) -> tuple[np.ndarray, pa.BinaryArray]:
    """A row per word: numbers of the text's language and of up to five words of its piece from there, 0 after its end; and the sorted names that they number from 1."""
    raw = [(t or "").encode() for t in texts]
    data = LOWER[np.frombuffer(b"\n".join(raw), np.uint8)]
    inside = ~APART[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    kept = np.ascontiguousarray(data[inside])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    text = np.searchsorted(np.cumsum([0, *(len(b) + 1 for b in raw)]), starts, side="right") - 1
    named = pa.array([("und" if x is None else x).encode() for x in langs], pa.binary()).dictionary_encode()
    coded = words.dictionary_encode()
    both = pa.concat_arrays([coded.dictionary, named.dictionary])
    names, number = numbered(both)
    columns = np.zeros((MOST + 1, len(starts)), np.int32)
    columns[0] = number[len(coded.dictionary) :][named.indices.to_numpy()][text]
    word = number[: len(coded.dictionary)][coded.indices.to_numpy()] if len(starts) else np.empty(0, np.int32)
    piece = np.cumsum(BREAK[data])[starts] if len(starts) else np.empty(0, int)
    for d in range(MOST):
        n = max(len(starts) - d, 0)
        columns[d + 1, :n] = np.where(piece[d:] == piece[:n], word[d:], 0)
    return columns, names


def numbered(values: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The distinct values in order, and each value's number among them, from 1."""
    distinct = values.dictionary_encode()
    order = pa.compute.sort_indices(distinct.dictionary)
    number = np.empty(len(order), np.int32)
    number[order.to_numpy()] = np.arange(1, len(order) + 1)
    return distinct.dictionary.take(order), number[distinct.indices.to_numpy()] if len(values) else np.empty(0, np.int32)


def ordered(columns: np.ndarray) -> np.ndarray:
    """Places of the columns' rows in lexicographic order; several numbers share a key where they fit."""
    bits = max(int(columns.max(initial=0)).bit_length(), 1)
    each, keys = max(1, 63 // bits), []
    for a in range(0, len(columns), each):
        key = np.zeros(columns.shape[1], np.int64)
        for c in columns[a : a + each]:
            key = (key << bits) | c
        keys.append(key)
    return np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")


class Trie:
    """Nodes of a count trie in order: their paths, depths (of a language 1, of a word 2) and counts."""

    def __init__(self, path: np.ndarray, depth: np.ndarray, count: np.ndarray):
        self.path, self.depth, self.count = path, depth, count

    @classmethod
    def of_positions(cls, columns: np.ndarray) -> Trie:
        rows = columns[:, ordered(columns)]
        n = rows.shape[1]
        length = (rows > 0).sum(axis=0, dtype=np.int8)
        same = np.zeros(n, np.int8)  # leading numbers in common with the row before
        if n:
            same[1:] = np.minimum(np.cumprod(rows[:, 1:] == rows[:, :-1], axis=0, dtype=np.int8).sum(axis=0, dtype=np.int8), length[1:])
        new = (length - same).astype(np.int32)
        row = np.repeat(np.arange(n, dtype=np.int32), new)
        depth = (np.arange(len(row), dtype=np.int32) - np.repeat(np.cumsum(new, dtype=np.int32) - new, new)).astype(np.int8) + same[row] + np.int8(1)
        count, runs = np.zeros(len(row), np.int32), np.zeros(n, np.int32)
        for d in range(1, len(rows) + 1):
            heads = np.flatnonzero(same < d)
            runs[heads] = np.diff(np.append(heads, n))
            count[depth == d] = runs[row[depth == d]]
        path = np.empty((len(rows), len(row)), np.int32)
        for d, column in enumerate(rows):
            path[d] = np.where(d < depth, column[row], 0)
        return cls(path, depth, count)

    @classmethod
    def merged(cls, path: np.ndarray, depth: np.ndarray, count: np.ndarray) -> Trie:
        """Sorted runs of nodes, one after another, brought into one order; equal paths are added up."""
        order = ordered(path)
        path = path[:, order]
        heads = np.flatnonzero(np.concatenate([[True], (path[:, 1:] != path[:, :-1]).any(axis=0)])) if len(order) else order
        return cls(path[:, heads], depth[order][heads], np.add.reduceat(count[order], heads, dtype=np.int64) if len(heads) else count[:0])

    def place(self, bound: list[bytes], names: np.ndarray) -> int:
        """The first node not before this path."""
        lo, hi = 0, self.path.shape[1]
        for column, word in zip(self.path, [*bound, *[None] * (MOST + 1 - len(bound))], strict=True):
            number = np.int32(0 if word is None else np.searchsorted(names, word) + 1)  # of the columns' type, or they are copied
            at = lo + int(np.searchsorted(column[lo:hi], number))
            if word is not None and (number > len(names) or names[number - 1] != word):
                return at
            lo, hi = at, lo + int(np.searchsorted(column[lo:hi], number, side="right"))
        return lo

    def serial(self, a: int, b: int, names: pa.BinaryArray) -> bytes:
        """Nodes from a to b, after their first one's ancestors, as a compressed Arrow stream of depth, name and count."""
        spine = int(self.depth[a]) - 1
        depth = np.concatenate([np.arange(1, spine + 1), self.depth[a:b]]).astype(np.uint8)
        last = np.concatenate([self.path[:spine, a], self.path[self.depth[a:b] - 1, np.arange(a, b)]])
        used, code = np.unique(last, return_inverse=True)
        name = pa.DictionaryArray.from_arrays(code.astype(np.int32), names.take(pa.array(used - 1)))
        batch = pa.RecordBatch.from_arrays([pa.array(depth), name, pa.array(np.concatenate([np.zeros(spine, np.int64), self.count[a:b]]))], names=["depth", "name", "count"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def kept(self, least: int) -> Trie:
        """Without nodes counted less often; languages, and ancestors that belong to the range before, stay."""
        some = (self.count >= least) | (self.count == 0) | (self.depth == 1)
        return Trie(self.path[:, some], self.depth[some], self.count[some])


def above(depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of each node's path down to it, by depth; a walk in order, as the last node of a depth before a node is its ancestor."""
    out, places = np.zeros((MOST + 1, len(depth)), values.dtype), np.arange(len(depth), dtype=np.int32)
    for d in range(1, MOST + 2):
        last = np.maximum.accumulate(np.where(depth == d, places, 0))
        out[d - 1] = np.where(depth >= d, values[last], 0)
    return out


def _merge(parts: list[bytes]) -> tuple[Trie, pa.BinaryArray]:
    tables = [pa.ipc.open_stream(p).read_all() for p in parts]
    name = pa.concat_tables(tables)["name"].unify_dictionaries()
    names, number = numbered(name.chunk(0).dictionary)
    last = number[np.concatenate([c.indices.to_numpy() for c in name.chunks])]
    depth = np.concatenate([t["depth"].to_numpy() for t in tables])
    count = np.concatenate([t["count"].to_numpy() for t in tables])
    return Trie.merged(above(depth, last), depth, count), names


def bounds(docs: DataFrame, chars: int, n_docs: int) -> list[list[bytes]]:
    """Paths that part the positions into ranges; from a bounded sample."""
    n = min(-(-chars // RANGE_CHARS), MOST_RANGES)
    if n < 2:
        return []
    fraction = min(1.0, SAMPLE_DOCS / n_docs)
    step = max(1, int(chars * fraction / 6 / SAMPLE_PATHS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                columns, names = paths(part.column("text").to_pylist(), part.column("lang").to_pylist())
                some = columns[:, int(columns.shape[1] % step) :: step]
                rows = [[names[x - 1].as_py() for x in row if x] for row in some.T.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.binary()))], names=["path"])

    drawn = docs.sample(fraction, seed=12) if fraction < 1 else docs
    found = sorted([bytes(w) for w in r[0]] for r in drawn.mapInArrow(run, "path array<binary>").limit(4 * SAMPLE_PATHS).collect())
    out = [found[i * len(found) // n] for i in range(1, n)] if found else []
    return [x for i, x in enumerate(out) if not i or x != out[i - 1]]


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, size, a and lefts of every path counted ``least`` times or more, written; languages have size 0 and a phrase of no words."""
    spark = docs.sparkSession
    chars, n_docs = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("text")).head()
    cuts = spark.sparkContext.broadcast(bounds(docs, chars, n_docs))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _filled(batches):
            columns, names = paths(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
            if not columns.shape[1]:
                continue
            trie, plain = Trie.of_positions(columns), np.array(names.to_pylist(), object)
            at = [0, *(trie.place(b, plain) for b in cuts.value), len(trie.depth)]
            some = [i for i in range(len(at) - 1) if at[i] < at[i + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([trie.serial(at[i], at[i + 1], names) for i in some], pa.binary())], names=["range", "part"])

    def merge(group: pa.Table) -> pa.Table:
        trie, names = _merge(group["part"].to_pylist())
        trie = trie.kept(least)
        up, rows = above(trie.depth, trie.count), []
        for i in np.flatnonzero(trie.count).tolist():
            words = [names[int(x) - 1].as_py().decode() for x in trie.path[: trie.depth[i], i]]
            lefts = [int(x) or None for x in up[1 : trie.depth[i] - 1, i]]
            rows.append((words[0], " ".join(words[1:]), len(words) - 1, int(trie.count[i]), lefts))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "phrase", "size", "a", "lefts"])

    parts = docs.where("text IS NOT NULL").mapInArrow(shards, "range int, part binary")
    return scratch(parts.groupBy("range").applyInArrow(merge, "lang string, phrase string, size int, a long, lefts array<long>"), "frequent")


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | pa.Table]:
    """Arrow batches cut, or put together, to about a shard's bytes each."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text", SHARD_BYTES):
            n = part.column("text").nbytes
            if held and size + n > SHARD_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held)


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of every language by their lowest-scoring cut, for (text, lang)."""
    kept = frequent(docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")), least)
    total = kept.where("size = 0").select("lang", F.col("a").alias("n"))
    phrases = kept.where("size >= 2").withColumn("words", F.split("phrase", " "))
    joined = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "size", "words", F.posexplode("lefts").alias("k", "l")).withColumn("k", F.col("k") + 1)
    cuts = cuts.withColumns({"right": joined(F.col("k") + 1, F.col("size") - F.col("k")), "left": F.when(F.col("l").isNull(), joined(F.lit(1), F.col("k")))}).drop("words")
    part = lambda name, value: kept.where("size >= 1").select("lang", F.col("phrase").alias(name), F.col("a").alias(value))
    cuts = cuts.join(part("right", "r"), ["lang", "right"]).join(part("left", "l_"), ["lang", "left"], "left").withColumn("l", F.coalesce("l", "l_"))
    exact = lambda c: F.col(c).cast("decimal(17,0)")
    whole = cuts.join(total, "lang").withColumns({"top": F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), "bottom": exact("l") * exact("r")})
    scored = whole.withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    inner = lambda at: phrases.where("size >= 3").select("lang", joined(at, F.col("size") - 1).alias("phrase"), "a")
    best = best.join(inner(F.lit(1)).unionByName(inner(F.lit(2))), ["lang", "phrase", "a"], "left_anti")  # a longer phrase around it is at most as frequent
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
