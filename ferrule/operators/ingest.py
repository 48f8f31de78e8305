"""Incremental ingestion: what changed, what goes, what is kept, and its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunks
from .predicates import where


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, status (new, changed, unchanged, removed), sha256 (now's, or the removed one's), by content only.

    One full outer join on path; both sides are shuffled once, whatever their sizes.
    """
    a = before.select("path", F.col("sha256").alias("old"))
    b = now.select("path", F.col("sha256").alias("new"))
    status = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"), F.coalesce("new", "old").alias("sha256"))


def to_process(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("status").isin("new", "changed"))


def chunk_rows(docs: DataFrame, keys: list[str], text: str = "text", size: int = 1200, overlap: int = 120) -> DataFrame:
    """keys, chunk_idx, start, end, chunk: one row per chunk that isn't blank."""
    return docs.select(*keys, F.explode(chunks(F.col(text), size, overlap)).alias("c")).select(*keys, F.col("c.idx").cast("long").alias("chunk_idx"), F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end"), F.col("c.text").alias("chunk"))


def upsert(stored: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Stored rows whose key isn't among the new ones, and of the new ones the last per key by ``seq`` if they have it.

    An anti join and one window over the new rows alone: stored rows aren't sorted.
    """
    keys = [key] if isinstance(key, str) else key
    if "seq" in new.columns:
        last = Window.partitionBy(*keys).orderBy(F.desc("seq"))
        new = new.withColumn("n_", F.row_number().over(last)).where("n_ = 1").drop("n_", "seq")
    else:
        new = new.dropDuplicates(keys)
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_where(stored: DataFrame, spec: dict) -> DataFrame:
    """Without the rows that match; an empty spec deletes nothing."""
    return stored.where(~where(spec, stored.columns)) if spec else stored


def delete_keys(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Without the rows whose keys are listed: ids, (path, sha256) versions, records, files."""
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def keep_live(stored: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose keys are live: NOT IN as a semi join, null-safe by construction."""
    return stored.join(live.select(*keys).distinct(), keys, "left_semi")


def replace_records(stored: DataFrame, new: DataFrame, touched: DataFrame, key: str = "record_id") -> DataFrame:
    """All rows of touched records replaced by the new ones, none of which means deletion."""
    return stored.join(touched.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_counts(stored: DataFrame, gone: DataFrame, keys: list[str], by: str) -> DataFrame:
    """by, before, after, deleted: what deleting the listed keys takes away."""
    marked = stored.join(gone.select(*keys).distinct().withColumn("gone_", F.lit(1)), keys, "left")
    deleted = F.count("gone_")
    return marked.groupBy(by).agg(F.count("*").alias("before"), (F.count("*") - deleted).alias("after"), deleted.alias("deleted"))


def count_versions(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """path, sha256, n: stored chunks of each asked version, 0 where there are none."""
    held = chunks.join(versions.select("path", "sha256").distinct(), ["path", "sha256"], "left_semi").groupBy("path", "sha256").agg(F.count("*").alias("n"))
    return versions.select("path", "sha256").distinct().join(held, ["path", "sha256"], "left").select("path", "sha256", F.coalesce("n", F.lit(0)).alias("n"))


def first_by_fingerprint(rows: DataFrame, *fingerprinted: Column, order: str) -> DataFrame:
    """The first row, in order, of those with equal fingerprints; each task merges its own before the shuffle."""
    named = rows.withColumn("fingerprint", F.sha2(F.concat_ws("\x1f", *fingerprinted), 256))
    return named.groupBy("fingerprint").agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("row")).select("row.*", "fingerprint")


def ingest_stats(diff: DataFrame, chunked: DataFrame) -> DataFrame:
    """One row: scanned, to_process, unchanged, tombstones, chunks, bytes."""
    scanned = diff.agg(
        F.count_if(F.col("status") != "removed").alias("scanned"),
        F.count_if(F.col("status").isin("new", "changed")).alias("to_process"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged"),
        F.count_if(F.col("status") == "removed").alias("tombstones"),
    )
    made = chunked.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.octet_length("chunk")), F.lit(0)).cast("long").alias("bytes"))
    return scanned.crossJoin(made)  # one row each
