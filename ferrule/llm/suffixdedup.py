"""Removal of bytes that repeat an earlier 100-byte string, by difference-cover suffix sorting.

1. Each 100-byte string has a fingerprint, the least hash of its 32-byte substrings, so equal
   strings have equal ones. Strings of a document that follow each other under one fingerprint are
   a span. A fingerprint met once, by one substring, has no repeated string and is left out (this
   is exact, not a sample).
2. Equal spans are settled by their first occurrence: all others go whole.
3. What is left are the first occurrences of spans that share a fingerprint and differ. They are
   shuffled by fingerprint, so that equal strings meet, and each task suffix-sorts them with the
   difference-cover algorithm: triples at positions not divisible by three are sorted and named,
   names sorted by recursion until they cover the string length, the other suffixes ordered by
   (byte, rank of the next) and merged in. Adjacent suffixes with equal 100-byte prefixes are one
   string; every occurrence but the earliest is repeated.
4. A fingerprint with more than ``HOT`` differing spans, or more than half a ``BLOCK`` of bytes in
   them, isn't sorted in one task: its strings are grouped by hash instead, merged by each task
   before they are shuffled.
5. Repeated strings of a document are merged to runs and cut out.

Strings are judged on the input, in (doc_id, start) order. Null and empty texts, and texts under
100 bytes, have nothing to remove. Where doc_ids repeat or are null, rows are ordered by doc_id (null
first), then by the text's digest; rows equal in both are one document with equal results. An empty table gives an empty table; extra
columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, scratch, slices, table, texts
from .wordhash import BYTE, mix

LENGTH, GRAM = 100, 32
HOT = 20_000
#: Bytes that a task sorts at once.
BLOCK = 2_500_000
FACTOR = 0x9FB21C651E98DF25
INVERSE = pow(FACTOR, -1, 1 << 64)


#: The same result in DuckDB SQL, by grouping all strings.
ORACLE_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS g FROM (SELECT *, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM later)) GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS h, sum(b - a) AS removed, count(*) AS spans FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, coalesce(k.spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept k USING (doc_id)"""


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]), dtype=np.uint64)


class Hashes:
    """Hashes of substrings of a text from its prefix sums; a hash doesn't depend on where its substring is."""

    up, down = _powers(FACTOR, 1), _powers(INVERSE, 1)

    def __init__(self, data: np.ndarray):
        if len(data) >= len(Hashes.up):
            Hashes.up, Hashes.down = _powers(FACTOR, 2 * len(data) + 2), _powers(INVERSE, 2 * len(data) + 2)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * Hashes.up[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * Hashes.down[start] + (end - start).astype(np.uint64))

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:n]) * Hashes.down[:n] + np.uint64(width))


def _window(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    step = 1
    while 2 * step <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def spans_of(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of texts laid end to end (first byte and size of each, of ``LENGTH`` bytes or more).

    Text number, fingerprint, hash, first string, number of strings, and 1 if its fingerprint may be
    that of two of its substrings.
    """
    width = LENGTH - GRAM + 1
    hashes = Hashes(data)
    grams = hashes.all(GRAM)
    prints = _window(grams, width, np.minimum)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first] += 1
    inside[first + sizes - LENGTH + 1] -= 1
    valid = np.cumsum(inside[: len(prints)], dtype=np.int8) > 0
    string = np.flatnonzero(valid)
    own = prints[string]
    text = np.searchsorted(first, string, side="right") - 1
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    start, n, text, own = string[at], np.diff(np.append(at, len(string))), text[at], own[at]
    # substrings that are the least of some string, and neighbours of those that are equal
    around = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero((_window(np.concatenate([around, np.where(valid, prints, np.uint64(0)), around]), width, np.maximum) == grams) & (grams > 0))
    tie = np.flatnonzero((grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) <= width))
    marks = np.zeros(len(start) + 1, np.int64)
    np.add.at(marks, np.searchsorted(start, chosen[tie] - width), 1)
    np.add.at(marks, np.searchsorted(start, chosen[tie + 1], side="right"), -1)
    twice = (np.cumsum(marks)[:-1] > 0).astype(np.int64)
    # a span may begin before the substring it is named after
    if len(tie):
        twice[1:] |= twice[:-1]
        twice[:-1] |= twice[1:]
    return text, own.view(np.int64), hashes.of(start, start + n + LENGTH - 1).view(np.int64), start - first[text], n, twice


def _packed(*columns: np.ndarray) -> np.ndarray:
    """One number per row in the order of the columns (none negative): shifted together where that fits, renamed first where not."""
    key = columns[0]
    for c in columns[1:]:
        bits = int(c.max(initial=0)).bit_length()
        if int(key.max(initial=0)).bit_length() + bits > 63:
            key = np.unique(key, return_inverse=True)[1]
        key = (key << bits) | c
    return key


def suffix_ranks(s: np.ndarray, reach: int) -> np.ndarray:
    """Ranks of all suffixes of s (symbols from 1 on), in an order by ``reach`` symbols at least, by difference cover."""
    n = len(s)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triple = _packed(t[sample], t[sample + 1], t[sample + 2])
    order = np.argsort(triple)
    sorted_ = triple[order]
    fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(sorted_)]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    if reach > 3 and not fresh.all():
        # the text of names: positions 1 mod 3, an end, positions 2 mod 3
        ranks = suffix_ranks(np.concatenate([names[: len(one)] + 1, [1], names[len(one) :] + 1]), -(-reach // 3))
        names = np.concatenate([ranks[: len(one)], ranks[len(one) + 1 :]]) + 1
        order = np.argsort(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    rest = np.arange(0, n, 3)
    is_one = order < len(one)
    ones, twos = sample[order[is_one]], sample[order[~is_one]]
    # merge: of a suffix at 0 mod 3, count those at 1 mod 3 and at 2 mod 3 before it, and the other way round
    both = np.concatenate([rest, ones])
    key, key_one = np.split(_packed(t[both], rank[both + 1]), [len(rest)])
    rest_order = np.argsort(key)
    rest, key = rest[rest_order], key[rest_order]
    both = np.concatenate([rest, twos])
    rest_two, key_two = np.split(_packed(t[both], t[both + 1], rank[both + 2]), [len(rest)])
    low = np.arange(len(rest)) + np.searchsorted(key_one, key, side="left") + np.searchsorted(key_two, rest_two, side="left")
    out = np.empty(n, np.int64)
    out[rest] = low
    place = np.arange(len(order))
    before = np.empty(len(order), np.int64)
    before[is_one] = np.searchsorted(key, key_one, side="right")
    before[~is_one] = np.searchsorted(rest_two, key_two, side="right")
    out[sample[order]] = place + before
    return out


def repeated_strings(parts: list[bytes], docs: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Of the strings in parts of documents (doc, start of the part): those that also are in the block at an earlier place."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    part = np.repeat(np.arange(len(parts)), sizes)
    at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text = np.zeros(len(data) + len(parts), np.int64)  # parts end with the least symbol
    text[np.arange(len(data)) + part] = data.astype(np.int64) + 2
    text[text == 0] = 1
    string = np.flatnonzero(at + LENGTH <= sizes[part])
    order = string[np.argsort(suffix_ranks(text, LENGTH)[string + part[string]], kind="stable")]
    whole = Hashes(data).of(order, order + LENGTH)
    group = np.cumsum(np.concatenate([[True], whole[1:] != whole[:-1]]))
    doc, place = docs[part[order]], starts[part[order]] + at[order]
    by = np.lexsort((place, doc, group))
    later = np.concatenate([[False], group[by][1:] == group[by][:-1]])
    found = order[by][later]
    flags = np.zeros(len(data), bool)
    flags[found] = True
    return np.split(flags, np.cumsum(sizes)[:-1])


def _runs(flags: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Flagged strings as byte runs of the document."""
    edges = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return [(int(a) + start, int(b) - 1 + LENGTH + start) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _span_rows(docs: DataFrame) -> DataFrame:
    """doc_id, print, hash, at, n, twice: all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [t.encode() for t in part.column("text").to_pylist()]
                long = [i for i, x in enumerate(raw) if len(x) >= LENGTH]
                if not long:
                    continue
                sizes = np.array([len(raw[i]) for i in long])
                data = np.frombuffer(b"".join([raw[i] for i in long]), np.uint8)
                text, *made = spans_of(data, np.cumsum(sizes) - sizes, sizes)
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)[np.array(long)[text]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, *made)], names=["doc_id", "print", "hash", "at", "n", "twice"])

    return docs.mapInArrow(run, "doc_id long, print long, hash long, at long, n long, twice long")


def _cut_parts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """print, doc_id, at, part: the bytes of the wanted spans (doc_id, print, at, n)."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("print", "at", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                prints, docs_, ats, parts = [], [], [], []
                for doc, t, spans in zip(*(some.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                    raw = t.encode()
                    for s in spans:
                        prints.append(s["print"])
                        docs_.append(doc)
                        ats.append(s["at"])
                        parts.append(raw[s["at"] : s["at"] + s["n"] + LENGTH - 1])
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(docs_, pa.int64()), pa.array(ats, pa.int64()), pa.array(parts, pa.binary())], names=["print", "doc_id", "at", "part"])

    return docs.join(lists, "doc_id").select("doc_id", "text", "spans").mapInArrow(run, "print long, doc_id long, at long, part binary")


RUNS = "doc_id long, start long, end long"


def _sorted_runs(parts: DataFrame) -> DataFrame:
    """Runs of repeated strings, by suffix-sorting blocks of whole fingerprints."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        found = []
        for (_, doc, at, _), flags in zip(rows, repeated_strings([r[3] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])), strict=True):
            found += [(doc, a, b) for a, b in _runs(flags, at)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=["doc_id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("print", "doc_id", "at", "part")), strict=True):
                if held >= BLOCK // 2 and row[0] != rows[-1][0]:
                    yield block(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3]) + 1
        if rows:
            yield block(rows)

    return parts.repartition("print").sortWithinPartitions("print", "doc_id", "at").mapInArrow(run, RUNS)


def _grouped_runs(parts: DataFrame) -> DataFrame:
    """The same for hot fingerprints: strings meet by hash, merged by each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, at, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "part")), strict=True):
                h = Hashes(np.frombuffer(part, np.uint8)).all(LENGTH)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), doc)), pa.array(at + np.arange(len(h)))], names=["string", "doc_id", "at"])

    strings = parts.mapInArrow(run, "string long, doc_id long, at long")
    first = strings.groupBy("string").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    later = strings.join(first, "string").where(F.struct("doc_id", "at") != F.col("first"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start = (batch.column(c).to_numpy() for c in ("doc_id", "at"))
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (np.diff(start) > LENGTH)])[: len(doc)])
            last = np.append(new[1:], len(doc))[: len(new)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[new], start[new], start[last] + LENGTH)], names=["doc_id", "start", "end"])

    return later.select("doc_id", "at").mapInArrow(merged, RUNS)


def _ordered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with doc_id replaced by a number of the same order where doc_ids repeat or are null, the old one as ``own``; and each document once."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return docs.withColumn("own", F.col("doc_id")), docs
    marked = docs.withColumn("digest", F.md5("text"))
    keys = scratch(marked.select("doc_id", "digest").distinct().repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").withColumn("rank", F.monotonically_increasing_id()), "order")
    both = marked.join(keys.withColumnRenamed("doc_id", "id").withColumnRenamed("digest", "d"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))
    numbered = both.select(F.col("rank").alias("doc_id"), "text", F.col("doc_id").alias("own"))
    return numbered, numbered.dropDuplicates(["doc_id"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, end: byte runs of (doc_id, text) covered by repeated strings; runs may overlap. doc_ids must differ."""
    spans = _span_rows(docs)
    again = scratch(spans.groupBy("print").agg(F.count("*").alias("k"), F.max("twice").alias("twice")).where("k > 1 OR twice = 1").select("print"), "prints")
    held = scratch(spans.join(again, "print"), "spans")
    firsts = scratch(held.groupBy("print", "hash").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.first("n").alias("n"), F.first("twice").alias("twice")), "firsts")
    copies = held.join(firsts.select("print", "hash", "first"), ["print", "hash"]).where(F.struct("doc_id", "at") != F.col("first"))
    copies = scratch(copies.select("doc_id", F.col("at").alias("start"), (F.col("at") + F.col("n") + LENGTH - 1).alias("end")), "copies")
    drop(again, held)
    kinds = scratch(firsts.groupBy("print").agg(F.count("*").alias("k"), F.max("twice").alias("any_twice"), F.sum(F.col("n") + LENGTH).alias("size")).where("k > 1 OR any_twice = 1").drop("any_twice"), "kinds")
    wanted = firsts.join(kinds, "print").select("print", "first.doc_id", "first.at", "n")
    parts = scratch(_cut_parts(docs, wanted), "parts")
    drop(firsts)
    hot = kinds.where((F.col("k") > HOT) | (F.col("size") > BLOCK // 2)).select("print")
    if hot.isEmpty():
        found = _sorted_runs(parts)
    else:
        found = _sorted_runs(parts.join(hot, "print", "left_anti")).unionByName(_grouped_runs(parts.join(hot, "print", "left_semi")))
    found = copies.unionByName(found)
    out = scratch(found, "runs")
    drop(copies, kinds, parts)
    return out


RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) for (doc_id, text)."""
    docs, once = _ordered(docs)
    lists = repeated_runs(once.select("doc_id", "text")).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, t, runs in zip(*(part.column(c).to_pylist() for c in ("own", "text", "runs")), strict=True):
                    raw = t.encode()
                    kept, at, n = [], 0, 0
                    for r in sorted(runs or [], key=lambda r: (r["start"], r["end"])):
                        if r["start"] > at or not n:
                            kept.append(raw[at : r["start"]])
                            n += 1
                        at = max(at, r["end"])
                    rows.append((doc, len(raw), b"".join(kept) + raw[at:], n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[1] - len(r[2]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return docs.join(lists, "doc_id", "left").select("own", "text", "runs").mapInArrow(run, f"doc_id long, {RESULT}")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(texts(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
