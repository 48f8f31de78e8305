"""Benchmark decontamination with suffix arrays over the training documents.

Every Arrow slice of documents is a shard: its words become one integer text, documents kept apart
by a separator, and a suffix array is sorted by rank doubling, to the window's depth. Every suffix of
the benchmark that can begin a match (it has a full window left) is binary-searched in it, equal
windows once: the range of suffixes that begin with it gives all verbatim occurrences. The places
found are then sorted together with the benchmark's suffixes, to the depth of the longest item:
neighbours in that order give each place's longest verbatim match, and each document's longest
match and where it is. Documents with a match go.

Equal items are one item with several ids, and ids are joined in at the end, so neither repeated
items nor windows that many items share multiply the occurrences. Suffixes that begin with a word no
benchmark item has cannot match and are left out of the array. Words are compared by 64-bit hashes.
Documents are never moved: the benchmark goes to them, in blocks of at most ``BLOCK_CHARS``
characters on average, each a broadcast; a slice meets ``BLOCKS`` blocks in one pass, and a larger
benchmark takes more passes, each of whose results are written, so that no more than these are held.
``longest_matches`` gives the same from the benchmark's side: every item's longest match over all documents.

A null text has no words; such documents, and empty ones, are clean. An item without words has no
window; a null item_id still marks words but isn't listed. Repeated rows are judged alike; of equally
long matches a document's first counts. A slice is at least one document, whose words must fit into a
task's memory some ten times over. Empty tables are fine on either side. Extra columns pass through
(columns named like the outputs are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, drop, scratch, slices, table, texts
from .wordhash import word_hashes

WINDOW = 10
BLOCK_CHARS, BLOCKS = 2_000_000, 8
#: Words of suffixes laid side by side in one search.
SEARCH_WORDS = 4_000_000
SHARD_BYTES = 6_000_000
OUTPUTS = "n_words long, hit_spans array<struct<start:int,end:int>>, hit_items array<string>, longest_match int, longest_at int"


#: The same result in DuckDB SQL, by joining windows instead of searching suffixes.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT item_id, k, q, array_to_string(list_slice(w, q + 1, q + k), ' ') AS win FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS q FROM i)),
dw AS (SELECT doc_id, k, p, array_to_string(list_slice(w, p + 1, p + k), ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i))),
h AS (SELECT doc_id, p, q, k, item_id FROM dw JOIN iw USING (k, win)),
n AS (SELECT DISTINCT doc_id, place FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM h)),
runs AS (SELECT doc_id, min(p) AS head, count(*) + any_value(k) - 1 AS run FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island FROM h) GROUP BY doc_id, item_id, p - q, island)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(a.n_hit, 0) AS n_hit, coalesce(b.n_items, 0) AS n_items, sha256(coalesce(b.items, '')) AS items_sha256, coalesce(a.n_hit, 0) > 0 AS contaminated,
CAST(coalesce(r.run, 0) AS INT) AS longest_match, CAST(r.head AS INT) AS longest_at
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n_hit FROM n GROUP BY 1) a USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1) b USING (doc_id)
LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY run DESC, head) = 1) r USING (doc_id)"""


class Suffixes:
    """All suffixes of a block of benchmark items, over the block's own vocabulary; equal items are one."""

    def __init__(self, ids: list, item_texts: list[str | None], window: int = WINDOW):
        hashes, offsets = word_hashes(item_texts)
        classes: dict[bytes, list[str]] = {}
        for i, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b > a:
                named = classes.setdefault(hashes[a:b].tobytes(), [])
                if i is not None:
                    named.append(str(i))
        self.ids = list(classes.values())
        hashes = np.frombuffer(b"".join(classes), np.uint64)
        n = np.array([len(x) // 8 for x in classes], np.int64)
        offsets = np.concatenate([[0], np.cumsum(n)])
        self.size = window
        self.vocabulary, words = np.unique(hashes, return_inverse=True)
        self.item = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(len(words)) - np.repeat(offsets[:-1], n)
        self.left = np.repeat(n, n) - self.at
        size = np.repeat(n, n)
        self.window = np.where(size >= window, np.where(self.left >= window, window, 0), np.where(self.at == 0, size, 0))
        self.depth = int(n.max()) if len(n) else 0
        self.flat = np.concatenate([words.astype(np.int32) + 1, np.full(self.depth, -1, np.int32)])
        self._distinct()

    def _distinct(self) -> None:
        """Distinct windows: their words side by side, sizes, and the items of each."""
        q = np.flatnonzero(self.window > 0)
        sizes = self.window[q]
        widest = int(sizes.max(initial=0))
        rows = np.where(np.arange(widest) < sizes[:, None], self.words(q, widest), 0) if len(q) else np.empty((0, widest), np.int32)
        self.windows, of = np.unique(rows, axis=0, return_inverse=True) if len(q) else (rows, np.empty(0, np.int64))
        self.sizes = np.count_nonzero(self.windows, axis=1)
        pairs = np.unique(np.stack([of.ravel(), self.item[q]], axis=1), axis=0)
        self.items, self.items_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))

    def words(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """The first words of these suffixes, side by side; words beyond an item's end are never compared."""
        return self.flat[rows[:, None] + np.arange(depth)]

    def runs(self) -> list[np.ndarray]:
        """All suffixes, in runs that can be laid side by side."""
        n = max(1, SEARCH_WORDS // max(1, self.depth))
        return [np.arange(a, min(a + n, len(self.item))) for a in range(0, len(self.item), n)]


class Shard:
    """Suffix array of a run of documents, for a given vocabulary, sorted by ``depth`` words at least."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray, depth: int):
        place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = np.where(vocabulary[place] == hashes, place + 1, 0).astype(np.int32)
        n = np.diff(offsets)
        self.first = offsets[:-1] + np.arange(len(n))  # a separator follows every document
        self.text = np.zeros(len(hashes) + len(n) + 2 * depth + 1, np.int32)
        self.text[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = known
        self.array = self._sorted(depth)

    def _sorted(self, depth: int) -> np.ndarray:
        at = np.flatnonzero(self.text)
        rank = self.text.astype(np.int64)
        base = max(len(rank), int(rank.max(initial=0))) + 1  # the first ranks are vocabulary numbers, which may exceed the text's length
        order, k = np.argsort(rank[at], kind="stable"), 1
        while k < depth:
            key = rank[at] * base + rank[at + k]
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(at) else np.empty(0, bool)
            rank[at[order]] = np.cumsum(new)
            if new.all():
                break
            k *= 2
        return at[order]

    def find(self, words: np.ndarray, depth: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of all rows of words at once, by their first ``depth`` words."""
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), len(self.array), np.int64)
        columns = np.arange(words.shape[1])
        for _ in range(len(self.array).bit_length()):
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            there = self.text[self.array[mid][:, None] + columns]
            unlike = (there != words[open_]) & (columns < depth[open_, None])
            k = unlike.argmax(axis=1)
            rows = np.arange(len(open_))
            differs = unlike[rows, k]
            after = np.where(differs, there[rows, k] < words[open_][rows, k], right)
            lo[open_] = np.where(after, mid + 1, lo[open_])
            hi[open_] = np.where(after, hi[open_], mid)
        return lo

    def common(self, places: np.ndarray, words: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Words that the suffixes at these places of the array share with each row of words."""
        inside = (places >= 0) & (places < len(self.array))
        columns = np.arange(words.shape[1])
        there = self.text[self.array[np.where(inside, places, 0)][:, None] + columns] if len(self.array) else np.zeros_like(words)
        unlike = (there != words) | (columns >= left[:, None])
        n = np.where(unlike.any(axis=1), unlike.argmax(axis=1), words.shape[1])
        return np.where(inside, n, 0)

    def longest(self, tests: Suffixes, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For these suffixes: words shared with the array's suffix before their place, with the one at it, and that place."""
        words, left = tests.words(rows, tests.depth), tests.left[rows]
        place = self.find(words, left, False)
        return self.common(place - 1, words, left), self.common(place, words, left), place

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, as many as n says, end to end."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _longest(shard: Shard, tests: Suffixes, starts: np.ndarray, ends: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Of hits, places within the spans of hit words: words of the longest match with any benchmark suffix.

    A match's words are all hit, so the spans' words and the benchmark's are sorted together, by rank
    doubling, to the depth of the longest item; ranks of all depths give the words that neighbours share.
    """
    n = ends - starts
    spans = np.repeat(np.arange(len(n)), n)
    place = _ranges(starts, n)
    text = np.empty(len(place) + len(n) + len(tests.item) + len(tests.ids), np.int64)
    mine = np.arange(len(place)) + spans
    other = len(place) + len(n) + np.arange(len(tests.item)) + tests.item
    apart = np.ones(len(text), bool)
    apart[mine] = apart[other] = False
    text[mine], text[other] = shard.text[place], tests.flat[: len(tests.item)]
    text[apart] = len(tests.vocabulary) + 1 + np.arange(np.count_nonzero(apart))  # no separator equals another
    levels, k = [np.unique(text, return_inverse=True)[1]], 1
    while k <= tests.depth:
        rank = levels[-1]
        after = np.full(len(text), -1)
        after[:-k] = rank[k:] if k < len(text) else after[:-k]
        levels.append(np.unique(rank * (len(text) + 1) + after + 1, return_inverse=True)[1])
        k *= 2
    order = np.argsort(levels[-1], kind="stable")
    is_test = np.zeros(len(text), bool)
    is_test[other] = True
    marks = np.flatnonzero(is_test[order])
    at = mine[np.searchsorted(place, hits)]
    spot = np.empty(len(text), np.int64)
    spot[order] = np.arange(len(text))
    near = np.searchsorted(marks, spot[at])
    best = np.zeros(len(at), np.int64)
    for side in (near - 1, near):
        there = (side >= 0) & (side < len(marks))
        to = order[marks[np.where(there, side, 0)]]
        shared = np.zeros(len(at), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            x, y = np.minimum(at + shared, len(text) - 1), np.minimum(to + shared, len(text) - 1)
            shared += (levels[j][x] == levels[j][y]).astype(np.int64) << j
        best = np.maximum(best, np.where(there, shared, 0))
    return best


def _matches(shard: Shard, tests: Suffixes, n_docs: int) -> tuple[list[list[tuple[int, int]]], list[set[str]], list[tuple[int, int]]]:
    """Per document: hit runs of words, the items with occurring windows, and (words, -place) of its longest match."""
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    items: list[set[str]] = [set() for _ in range(n_docs)]
    longest: list[tuple[int, int]] = [(0, 0)] * n_docs
    if not len(tests.windows) or not len(shard.array):
        return spans, items, longest
    lo, hi = shard.find(tests.windows, tests.sizes, False), shard.find(tests.windows, tests.sizes, True)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return spans, items, longest
    counts = (hi - lo)[found]
    window = np.repeat(found, counts)
    at = shard.array[_ranges(lo[found], counts)]
    size = tests.sizes[window]
    step = np.zeros(len(shard.text) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    edges = np.flatnonzero(np.diff(np.cumsum(step) > 0, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    for a, b, d in zip(starts.tolist(), ends.tolist(), shard.document(starts).tolist(), strict=True):
        spans[d].append((a - int(shard.first[d]), b - int(shard.first[d])))
    hits, of = np.unique(at, return_inverse=True)
    whole = np.zeros(len(hits), np.int64)
    np.maximum.at(whole, of, size)
    shared = _longest(shard, tests, starts, ends, hits)
    n = np.where(shared >= tests.size, shared, whole)
    doc = shard.document(hits)
    for d, k, p in zip(doc.tolist(), n.tolist(), (shard.first[doc] - hits).tolist(), strict=True):
        longest[d] = max(longest[d], (k, p))
    pairs = np.unique(np.stack([shard.document(at), window], axis=1), axis=0)
    n_items = np.diff(tests.items_at)[pairs[:, 1]]
    both = np.stack([np.repeat(pairs[:, 0], n_items), tests.items[_ranges(tests.items_at[pairs[:, 1]], n_items)]], axis=1)
    for d, i in np.unique(both, axis=0).tolist():
        items[d].update(tests.ids[i])
    return spans, items, longest


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Suffixes]:
    """The benchmark's suffixes in blocks, fetched one after another; none is larger than planned by more than chance."""
    total = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    n = max(1, -(-total // BLOCK_CHARS))
    for b in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select("item_id", "text").collect()
        yield Suffixes([r.item_id for r in rows], [r.text for r in rows], window)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, hit_spans (runs of hit words, end exclusive), hit_items (sorted ids of matching items),
    longest_match (words of the longest verbatim match, 0 without one) and longest_at (its first word)."""
    added = T.StructType.fromDDL(OUTPUTS)
    out = docs.drop(*added.names).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    before, held = out, None
    for some in batched(blocks(benchmark, window), BLOCKS):
        if held is not None:  # the passes before are written, so their blocks and tables can go
            out = scratch(out, "matches")
            held.destroy()
            drop(before)
            before = out
        held = docs.sparkSession.sparkContext.broadcast(some)
        out = out.mapInArrow(_matcher(held, text_col, out.schema), out.schema)
    return out


def _matcher(tests, text_col: str, schema: T.StructType):
    """A map over documents that adds the matches of some blocks to those found before."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SHARD_BYTES):
                hashes, offsets = word_hashes(part.column(text_col).to_pylist())
                old = part.select(["hit_spans", "hit_items", "longest_match", "longest_at"]).to_pylist()
                spans = [[(s["start"], s["end"]) for s in r["hit_spans"] or []] for r in old]
                items = [set(r["hit_items"] or []) for r in old]
                longest = [(r["longest_match"] or 0, -(r["longest_at"] or 0)) for r in old]
                for block in (b for b in tests.value if len(b.windows)):
                    shard = Shard(hashes, offsets, block.vocabulary, int(block.sizes.max(initial=0)))
                    for i, (more, ids, best) in enumerate(zip(*_matches(shard, block, len(old)), strict=True)):
                        spans[i] += more
                        items[i] |= ids
                        longest[i] = max(longest[i], best)
                made = {
                    "n_words": np.diff(offsets),
                    "hit_spans": [_merged(x) for x in spans],
                    "hit_items": [sorted(x) for x in items],
                    "longest_match": [k for k, _ in longest],
                    "longest_at": [-p if k else None for k, p in longest],
                }
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else part.column(f.name) for f in arrow], schema=arrow)

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per item: n_words of its longest verbatim match, where it starts in the item, and doc_id and first word of that match."""
    schema = "item_id array<string>, n_words int, item_at int, doc_id string, doc_at int"
    found = None
    for block in blocks(benchmark):
        tests = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            q = tests.value
            for batch in batches:
                for part in slices(batch, text_col, SHARD_BYTES):
                    hashes, offsets = word_hashes(part.column(text_col).to_pylist())
                    if not q.depth or not len(hashes):
                        continue
                    shard = Shard(hashes, offsets, q.vocabulary, q.depth)
                    before, here, place = (np.concatenate(x) for x in zip(*(shard.longest(q, rows) for rows in q.runs()), strict=True))
                    n = np.maximum(before, here)
                    rows = np.flatnonzero(n)
                    if not len(rows):
                        continue
                    at = shard.array[np.where(before > here, place - 1, place)[rows]]
                    best = rows[np.lexsort((q.at[rows], -n[rows], q.item[rows]))]
                    best = best[np.unique(q.item[best], return_index=True)[1]]
                    at = at[np.searchsorted(rows, best)]
                    d = shard.document(at)
                    ids = part.column(id_col)
                    yield pa.RecordBatch.from_pydict(
                        {"item_id": pa.array([q.ids[i] for i in q.item[best].tolist()], pa.list_(pa.string())), "n_words": pa.array(n[best], pa.int32()), "item_at": pa.array(q.at[best], pa.int32()), "doc_id": pa.array([str(ids[i].as_py()) for i in d.tolist()]), "doc_at": pa.array(at - shard.first[d], pa.int32())}
                    )

        one = docs.select(id_col, text_col).mapInArrow(run, schema)
        one = one.withColumn("item_id", F.explode("item_id"))
        found = one if found is None else found.unionByName(one)
    best = F.max(F.struct("n_words", -F.col("item_at"), "doc_id", "doc_at"))
    return found.groupBy("item_id").agg(best.alias("b"), F.max_by("item_at", F.struct("n_words", -F.col("item_at"), "doc_id", "doc_at")).alias("item_at")).select("item_id", "b.n_words", "item_at", "b.doc_id", "b.doc_at")


def n_hit():
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a verbatim match of a window or more."""
    own, back = aside(docs, text_col)
    return back(match_benchmark(own, benchmark, text_col).where("longest_match = 0").select(own.columns))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_benchmark(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
        "longest_match",
        "longest_at",
    )
