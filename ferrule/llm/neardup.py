"""MinHash near-dedup with ProbMinHash signatures: banding, exact verification, connected classes.

A text's shingles are its runs of five words (one of all words, if it has fewer), weighted by how
often they occur in it. Each shingle is a Poisson process whose rate is its weight; its arrivals
fall on random registers, and a register keeps the shingle that arrives first. A shingle's process
stops once it is later than every register's first arrival, so a text takes about as many arrivals
as it has shingles, plus registers times their logarithm, not their product. Two texts agree in a
register with the probability Jaccard similarity of their weighted shingles.

Equal texts are one node. Nodes with an equal band of registers share a bucket. In a bucket every
member is verified against its pivot, the member with the most bucket mates over all its buckets
(the text the others were made from, as a rule), never each against each. Classes are then the
connected components of the verified links, found by star contraction. A bucket whose members are
all in one class is done. In the others, pairs of members of different classes may still be links;
two bounds rule most of them out inside the join, before any pair is made. First, 1 - similarity is
a metric, so members whose distances to the pivot differ too much aren't linked. Second, members
of such buckets get a sketch of ``SKETCH`` more registers, two bits each; a pair whose sketches
agree in fewer places than a link's do, less ``SPREAD`` standard deviations, isn't one (1 link at the
threshold in a billion is lost to this, far fewer than the 5 in 100,000 that banding loses; the bits
depend on element and register, so this holds for short texts too). The pairs that are left are
verified. There is no cap; like any MinHash method, this one can miss links, with these odds.

Hot keys: equal texts are merged by each task before they are shuffled. Joins by the key of a text, a
pivot or a class keep all rows of a hot one in one partition, which adaptive execution splits where it is
larger than ``spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes``: none of these joins is
followed by an operator that would forbid it. A text's shingles must fit into a task's memory.

A null text equals an empty one; texts without words are one class only if equal. A null doc_id
keeps its row and class. Repeated rows and equal doc_ids keep their rows. An empty table gives an
empty table; extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, drop, scratch, slices, table, texts
from .wordhash import mix, word_hashes

WORDS, LEAST = 5, 0.8
#: 25 bands of 5: a link at 0.8 shares a bucket with probability 0.99995, one at 0.85 with 0.9999995.
BANDS, ROWS = 25, 5
#: Registers of the sketch that open bucket mates are compared by; 32 of two bits make a long.
SKETCH, SPREAD = 1024, 6.0


def shingles(hashes: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, 64-bit shingle, weight; by text, then shingle."""
    n = np.diff(offsets)
    width = np.minimum(n, words)
    with np.errstate(over="ignore"):
        value, padded = np.zeros(len(hashes), np.uint64), np.concatenate([hashes, np.zeros(words, np.uint64)])
        size = np.repeat(width, n)
        for j in range(words):
            value += np.where(j < size, mix(padded[j : j + len(hashes)] + np.uint64(j)), np.uint64(0))
        value = mix(value + size.astype(np.uint64))
    text = np.repeat(np.arange(len(n)), n)
    whole = np.arange(len(hashes)) - offsets[:-1][text] <= (n - width)[text]
    text, value = text[whole], value[whole]
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])) if len(text) else np.empty(0, int)
    return text[first], value[first], np.diff(np.append(first, len(text))).astype(float)


def _uniform(element: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Of the k-th arrivals of elements: a number between 0 and 1; a row per k."""
    with np.errstate(over="ignore"):
        step = k.astype(np.uint64)[:, None] * np.uint64(0x2545F4914F6CDD1D)
        return ((mix(element[None, :] + step) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _register(element: np.ndarray, k: np.ndarray, m: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        step = k.astype(np.uint64)[:, None] * np.uint64(0x14057B7EF767814F)
        return (mix((element ^ np.uint64(0x5851F42D4C957F2D))[None, :] + step) % np.uint64(m)).astype(np.int64)


def probminhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """The element that arrives first at each of m registers, per text (0 where a text has no elements)."""
    arrival, first = np.full(n_texts * m, np.inf), np.zeros(n_texts * m, np.uint64)
    at, x, k = np.arange(len(element)), np.zeros(len(element)), 0
    latest = np.full(n_texts, np.inf)
    while len(at):
        # few processes left: several arrivals of each at once; those after the latest first arrival change nothing
        ahead = np.arange(k + 1, k + 1 + max(1, min(64, 4096 // len(at))))
        k = int(ahead[-1])
        e = element[at]
        times = np.cumsum(-np.log(_uniform(e, ahead)) / weight[at], axis=0) + x
        register = text[at] * m + _register(e, ahead, m)
        np.minimum.at(arrival, register.ravel(), times.ravel())
        won = arrival[register] == times
        first[register[won]] = np.broadcast_to(e, won.shape)[won]
        live = np.unique(text[at])
        latest[live] = arrival.reshape(n_texts, m)[live].max(axis=1)
        x = times[-1]
        on = x < latest[text[at]]
        at, x = at[on], x[on]
    return first.reshape(n_texts, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two texts' sorted distinct shingles and weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    last = np.searchsorted(ratio, ratio, side="right")
    below, above = np.cumsum(x)[last - 1], np.concatenate([np.cumsum(y[::-1])[::-1], [0.0]])[last]
    both = (x > 0) & (y > 0)
    return float(np.sum(x[both] / (below[both] + above[both] / ratio[both])))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text) and the hashes of the bands of its registers, for (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = word_hashes(part.column("text").to_pylist())
                n = len(offsets) - 1
                text, element, weight = shingles(hashes, offsets)
                registers = probminhash(text, element, weight, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
                with np.errstate(over="ignore"):
                    value = np.zeros((n, BANDS), np.uint64)
                    for j in range(ROWS):
                        value = mix(value + registers[:, :, j])
                    value = mix(value + np.arange(BANDS, dtype=np.uint64))
                some = np.diff(offsets) > 0
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([[0], some * BANDS])), pa.int32()), pa.array(value[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), bands], names=["doc_id", "key", "bands"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id long, key binary, bands array<long>")


def member_texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """key and text of all that share a bucket with another, once, written: the only shuffle of texts by key."""
    keys = members.select("key").union(members.select("pivot")).distinct()
    one = docs.select(F.unhex(F.md5("text")).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    return scratch(one.join(keys, "key", "left_semi"), "texts")


def verify(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """a, b and their exact similarity, for pairs of keys of ``member_texts``, written."""
    joined = (
        pairs.join(held.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
        .join(held.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                sides = []
                for name, col in (("a", "text_a"), ("b", "text_b")):
                    keys, index = np.unique(np.array(part.column(name).to_pylist(), dtype=object), return_inverse=True)
                    unique = [""] * len(keys)
                    for i, t in zip(index.tolist(), part.column(col).to_pylist(), strict=True):
                        unique[i] = t
                    text, element, weight = shingles(*word_hashes(unique))
                    bounds = np.searchsorted(text, np.arange(len(unique) + 1))
                    sides.append([(element[p:q], weight[p:q]) for i in index.tolist() for p, q in [bounds[i : i + 2]]])
                sim = [similarity(x, y) for x, y in zip(*sides, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sim, pa.float64())], names=["a", "b", "sim"])

    return scratch(joined.mapInArrow(run, "a binary, b binary, sim double"), "sims")


def components(links: DataFrame) -> DataFrame:
    """key and root, the least key of its component, for the keys of links (a, b) that aren't roots; by star contraction."""
    edges = scratch(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = scratch(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = scratch(small, "small")
        drop(edges, large)
        edges = after
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Every key has one edge up or is a root."""
    ends = edges.select(F.col("a").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size, key (digest of the text) and stays, one row per row of (doc_id, text).

    ``stays`` marks the least doc_id's rows of a class, of one text.
    """
    signed = scratch(signatures(docs), "signed")
    nodes = signed.groupBy("key").agg(F.first("bands").alias("bands"))
    banded = scratch(nodes.select("key", F.explode("bands").alias("bucket")), "banded")
    counts = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch(banded.join(counts, "bucket"), "shared")
    drop(banded)
    degree = shared.groupBy("key").agg(F.sum("n").alias("degree"))
    pivots = shared.join(degree, "key").groupBy("bucket").agg(F.max(F.struct("degree", "key"))["key"].alias("pivot"))
    members = scratch(shared.join(pivots, "bucket").where("key <> pivot").drop("n"), "members")
    drop(shared)
    held = member_texts(members, docs)
    sims = verify(members.select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct(), held)
    links = sims.where(F.col("sim") >= least)
    roots = components(links)
    rest = open_pairs(members, sims, roots, held, least)
    if not rest.isEmpty():
        more = verify(rest, held)
        old = roots
        roots = components(old.select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(more.where(F.col("sim") >= least).select("a", "b")))
        drop(old, more)
    drop(rest, members, sims, held)
    labelled = signed.select("doc_id", "key").join(roots, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))
    classes = labelled.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(place).alias("least"))
    return labelled.join(classes, "root").select("doc_id", "class_id", "class_size", "key", (place == F.col("least")).alias("stays"))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One document of each class of near copies, all columns; repeated rows of it count once."""
    columns = docs.columns
    docs, back = aside(docs, "doc_id", "text")
    found = near_duplicates(texts(docs), least).where("stays").select(F.col("doc_id").alias("id_"), F.col("key").alias("key_"))
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    kept = docs.withColumn("digest_", digest).join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("digest_") == F.col("key_")), "left_semi")
    return back(kept.dropDuplicates(["doc_id", "digest_"]).select(docs.columns)).toDF(*columns)


def sketches(keys: DataFrame, held: DataFrame) -> DataFrame:
    """key and sketch (array of long) of the texts of these keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                won = probminhash(*shingles(*word_hashes(part.column("text").to_pylist())), part.num_rows, SKETCH)
                with np.errstate(over="ignore"):  # bits of element and register: chance agreements of two elements are independent
                    bits = mix(mix(won) + np.arange(SKETCH, dtype=np.uint64)) & np.uint64(3)
                packed = np.bitwise_or.reduce(bits.reshape(part.num_rows, -1, 32) << (2 * np.arange(32, dtype=np.uint64)), axis=2)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(list(packed.view(np.int64)), pa.list_(pa.int64()))], names=["key", "sketch"])

    return held.join(keys, "key", "left_semi").mapInArrow(run, "key binary, sketch array<long>")


def agreeing(a: str, b: str) -> Column:
    """Registers in which two sketches agree."""
    unlike = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(SKETCH // 32)]
    either = [x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)) for x in unlike]
    return F.lit(SKETCH) - sum((F.bit_count(x) for x in either[1:]), F.bit_count(either[0]))


def least_agreement(least: float) -> int:
    p = least + (1 - least) / 4
    return int(SKETCH * p - SPREAD * (SKETCH * p * (1 - p)) ** 0.5)


def open_pairs(members: DataFrame, sims: DataFrame, roots: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Pairs of bucket mates in different classes that may still be links, written."""
    label = lambda of: roots.select(F.col("key").alias(of), F.col("root").alias(f"{of}_root"))
    known = (
        members.join(sims.select(F.col("a").alias("key"), F.col("b").alias("pivot"), F.col("sim")), ["key", "pivot"])
        .join(label("key"), "key", "left")
        .join(label("pivot"), "pivot", "left")
        .select("bucket", "key", "sim", F.coalesce("key_root", "key").alias("root"), F.coalesce("pivot_root", "pivot").alias("pivot_root"))
    )
    known = scratch(known, "known")
    buckets = known.where("root <> pivot_root").select("bucket").distinct()
    still = scratch(known.join(buckets, "bucket", "left_semi"), "open")
    lists = still.groupBy("key").agg(F.collect_set("bucket").alias("buckets"))  # at most one per band
    drawn = scratch(sketches(still.select("key").distinct(), held).join(lists, "key"), "sketches")
    flags = (F.col("root") != F.col("pivot_root")).alias("outside")
    rows = still.join(drawn, "key").select("bucket", "key", "sim", "root", flags, "sketch", "buckets")
    side = lambda x: rows.select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in rows.columns[1:]))
    a, b = side("a").where("outside_a"), side("b")
    near = F.abs(F.col("sim_a") - F.col("sim_b")) <= 1 - least + 1e-9
    once = ~F.col("outside_b") | (F.col("key_a") < F.col("key_b"))
    alike = agreeing("sketch_a", "sketch_b") >= least_agreement(least)
    first = F.array_min(F.array_intersect("buckets_a", "buckets_b")) == a["bucket"]  # of the buckets that a pair shares, one makes it
    pairs = a.join(b, (a["bucket"] == b["bucket"]) & (F.col("root_a") != F.col("root_b")) & near & once & alike & first)
    pairs = pairs.select(F.greatest("key_a", "key_b").alias("a"), F.least("key_a", "key_b").alias("b")).distinct()
    done = sims.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    out = scratch(pairs.join(done, ["a", "b"], "left_anti"), "rest")
    drop(known, still, drawn)
    return out


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(texts(table(spark, sf_dir, "documents"))).select("doc_id", "class_id", "class_size")
