"""Language of texts and pages by Bayesian fusion of independent evidence.

The posterior of a language is the product of

* the text's likelihood: a naive Bayes model over hashed byte trigrams, its counts gathered from all
  labelled training texts by one grouped aggregation; neighbouring trigrams aren't independent, so
  the mean log likelihood counts for at most ``STRENGTH`` trigrams;
* how often pages whose text is of this language declare the language that the markup declares;
* how often their address ends in this one's suffix;
* a prior of the host, smoothed hierarchically: a host's counts are backed by its domain's, these
  by all rows', each with the weight of ``BACKING`` rows; a row's own vote is taken out of all counts
  first.

Votes are the languages that texts alone suggest; texts under ``LEAST_TRIGRAMS`` have none.

Documents have a source for a host and declare nothing. Null or empty texts, markup and addresses
add no evidence; a row without any gets the prior. Repeated rows vote each; of equally likely languages
the alphabetically first is taken. Texts of any length are read whole, a slice of rows at a time, and
markup is cut in linear time. Without training labels the only language is 'und'. Empty tables give empty
tables. Id columns may have any name and pass through (those named like the outputs are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, table

BUCKETS = 1 << 14
STRENGTH, LEAST_TRIGRAMS, BACKING, SMOOTHING = 40.0, 10, 10.0, 0.5
#: Rows times languages whose posteriors are computed at once.
CELLS = 1_000_000
OUTPUTS = ("lang", "probability", "text_lang", "declared")

ASCII_LOWER = np.arange(256, dtype=np.int64)
ASCII_LOWER[0x41:0x5B] += 0x20


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams, and offsets of the texts in them; a space stands before and after every text."""
    raw = [b" " + t.encode() + b" " if t else b"" for t in texts]
    data = ASCII_LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.cumsum([0, *map(len, raw)])
    if len(data) < 3:
        return np.empty(0, np.int64), np.zeros(len(raw) + 1, np.int64)
    bucket = ((data[:-2] * 0x10001 + data[1:-1] * 0x101 + data[2:]) * 0x9E3779B1 >> 8) % BUCKETS
    inside = np.ones(len(bucket), bool)
    for cut in (ends[1:-1] - 1, ends[1:-1] - 2):  # trigrams over a border
        inside[cut[(cut >= 0) & (cut < len(bucket))]] = False
    counts = np.maximum(np.diff(ends) - 2, 0)
    return bucket[inside], np.concatenate([[0], np.cumsum(counts)])


@dataclass(frozen=True)
class Trigrams:
    languages: list[str]
    log_p: np.ndarray

    def log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the tempered log likelihood; and the texts' numbers of trigrams."""
        buckets, offsets = trigrams(texts)
        n = np.diff(offsets)
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(n)
        for k, p in enumerate(self.log_p):
            if len(some):
                out[some, k] = np.add.reduceat(p[buckets], offsets[some]) / n[some] * np.minimum(n[some], STRENGTH)
        return out, n


def train(labelled: DataFrame) -> Trigrams:
    """From (text, lang): trigram counts by language over all rows."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect()) or ["und"]
    at = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                buckets, offsets = trigrams(part.column("text").to_pylist())
                label = np.array([at[x] for x in part.column("lang").to_pylist()])
                new, times = np.unique(np.repeat(label, np.diff(offsets)) * BUCKETS + buckets, return_counts=True)
                cells, where = np.unique(np.concatenate([cells, new]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n, times]), len(cells)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells // BUCKETS, pa.int32()), pa.array(cells % BUCKETS, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])

    counts = np.full((len(languages), BUCKETS), SMOOTHING)
    long = rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[long.column("lang").to_numpy(), long.column("bucket").to_numpy()] += long.column("n").to_numpy()
    return Trigrams(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def _without(html: Column, opening: str, closing: str) -> Column:
    """Without what stands between an opening and the next closing mark, or the end; each part is read once."""
    return F.array_join(F.transform(F.split(html, closing), lambda part: F.regexp_replace(part, f"(?is){opening}.*", " ")), " ")


def page_text(html: Column) -> Column:
    bare = _without(_without(html, "<!--", "-->"), r"<(?:script|style)\b", r"(?i)</(?:script|style)\s*+>")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^<>]*+>", " "), r"&[A-Za-z]{2,8};|&#[0-9xA-Fa-f]{1,7};", " ")


def declared_language(html: Column) -> Column:
    """Primary subtag of the root element's language, lower-case; null where there is none."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<html\b[^>]*+)"), 1)  # each character is read once
    named = F.transform(tags, lambda t: F.lower(F.regexp_extract(t, r"(?i)\blang\s*+=\s*+[\"']?([a-z]{2,3})(?![a-z])", 1)))
    return F.get(F.filter(named, lambda x: x != ""), F.lit(0))


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def identify(rows: DataFrame, model: Trigrams) -> DataFrame:
    """rows (any id columns; text, markup, host) with lang, probability, text_lang; ids first. host null: no host."""
    named = [c for c in rows.columns if c not in ("text", "markup", "host", *OUTPUTS)]
    ids = [f"id{i}_" for i in range(len(named))]
    n_lang = len(model.languages)
    spread = rows.select(
        *(F.col(f"`{c}`").alias(i) for c, i in zip(named, ids, strict=True)),
        "text",
        "markup",
        "host",
        F.when(F.col("host").contains("."), F.substring_index("host", ".", -2)).otherwise(F.col("host")).alias("domain"),
        F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).alias("suffix"),
    )
    kept = [*ids, "markup", "host", "domain", "suffix"]
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

    schema = StructType([*(spread.schema[c] for c in kept), StructField("fit", ArrayType(DoubleType())), StructField("vote", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fit, n = model.log_likelihoods(part.column("text").to_pylist())
                vote = pa.array(fit.argmax(axis=1), pa.int32(), mask=n < LEAST_TRIGRAMS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(list(fit)), vote], names=[*kept, "fit", "vote"])

    seen = scratch(spread.mapInArrow(run, schema), "evidence")
    voted = seen.where("vote IS NOT NULL")

    def counted(key: str) -> DataFrame:
        """Votes of each value of the key: a list of languages and numbers per value."""
        long = voted.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{key}_"), "vote").agg(F.count("*").alias("n"))
        return long.groupBy(f"{key}_").agg(F.collect_list(F.struct("vote", "n")).alias(f"{key}_votes"))

    total = np.zeros(n_lang)
    for r in voted.groupBy("vote").agg(F.count("*").alias("n")).collect():
        total[r.vote] = r.n
    share = (total + SMOOTHING) / (total.sum() + SMOOTHING * n_lang)
    kinds = seen.agg(*(F.count_distinct(k).alias(k) for k in ("markup", "suffix"))).head().asDict()
    out = seen
    for key in ("markup", "suffix", "domain", "host"):
        other = counted(key)
        out = out.join(other, F.col(key) == F.col(f"{key}_"), "left").drop(f"{key}_")

    def dense(part: pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray]:
        """Votes of the rows' values of the key, by language; and which rows have a value."""
        lists = part.column(f"{key}_votes")
        flat = lists.flatten()
        here = np.zeros((part.num_rows, n_lang))
        n = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        here[np.repeat(np.arange(part.num_rows), n), flat.field("vote").to_numpy()] = flat.field("n").to_numpy()
        return here, part.column(key).is_valid().to_numpy(zero_copy_only=False)[:, None]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, CELLS // n_lang)
        for batch in batches:
            for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
                vote = part.column("vote").fill_null(-1).to_numpy()
                own = (vote[:, None] == np.arange(n_lang)).astype(float)
                prior = np.broadcast_to(share, own.shape)
                for key in ("domain", "host"):
                    here, there = dense(part, key)
                    n = here.sum(axis=1, keepdims=True) - (vote >= 0)[:, None]
                    prior = np.where(there, (here - own + BACKING * prior) / (n + BACKING), prior)
                value = part.column("fit").flatten().to_numpy().reshape(own.shape) + np.log(prior)
                for key in ("markup", "suffix"):
                    here, there = dense(part, key)
                    value += np.log(np.where(there, (here - own + SMOOTHING) / (total - own + SMOOTHING * kinds[key]), 1.0))
                lang = [model.languages[k] for k in value.argmax(axis=1).tolist()]
                probability = 1 / np.exp(value - value.max(axis=1, keepdims=True)).sum(axis=1)
                text_lang = [model.languages[k] if k >= 0 else None for k in vote.tolist()]
                made = [pa.array(lang, pa.string()), pa.array(probability, pa.float64()), pa.array(text_lang, pa.string()), part.column("markup")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ids), *made], names=[*ids, "lang", "probability", "text_lang", "declared"])

    result = StructType([*(seen.schema[c] for c in ids), StructField("lang", StringType()), StructField("probability", DoubleType()), StructField("text_lang", StringType()), StructField("declared", StringType())])
    return out.mapInArrow(fuse, result).toDF(*named, *OUTPUTS)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages; the text model learns from all labelled documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = train(docs)
    none = F.lit(None)
    of_docs = docs.select(F.lit("document").alias("kind"), "doc_id", none.cast("long").alias("page_id"), "text", none.cast("string").alias("markup"), F.col("source").alias("host"))
    of_pages = pages.select(F.lit("page").alias("kind"), none.cast("long").alias("doc_id"), "page_id", page_text(F.col("html")).alias("text"), declared_language(F.col("html")).alias("markup"), host_of(F.col("url")).alias("host"))
    return identify(of_docs.unionByName(of_pages), model)
