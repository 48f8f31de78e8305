"""Memory histories: created, filled, renamed, deleted and ingested, each as one commit over files, records and vectors.

Tables of a store: ``files`` (file_id, title, filename, created, updated), ``records`` (record_id, file_id and others)
and ``vectors`` (record_id, vector_id, file_id and others); a record's vectors are replaced together. All functions take
many files at once. What they check is read in the same change, so two of them at once can't both take a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, history_name, safe_title, strip
from ..sources.commits import Change, Store

FILES = "file_id string, title string, filename string, created timestamp, updated timestamp"
PREFIX = 16  # characters of a file name's time: year to minute


def _names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(file_id, stem and others) with a filename: the stem, or where it is taken or asked for before, the stem and the id's first characters."""
    first = F.row_number().over(Window.partitionBy("stem").orderBy("file_id")) == 1
    free = wanted.withColumn("first_", first).join(taken.select(F.col("filename").alias("stem"), F.lit(True).alias("taken_")).distinct(), "stem", "left")
    own = F.concat_ws("-", "stem", F.substring("file_id", 1, 8))
    return free.withColumn("filename", F.when(F.col("taken_").isNull() & F.col("first_"), F.col("stem")).otherwise(own)).drop("stem", "first_", "taken_")


def _refuse(rows: DataFrame, why: str) -> None:
    if found := rows.select("file_id").head():
        raise ValueError(f"{why}: {found[0]}")


def create(store: Store, new: DataFrame) -> int:
    """New, empty histories of (file_id, title, created). Blank titles and ids that are there are errors."""
    rows = new.select(F.col("file_id").cast("string").alias("file_id"), strip(F.col("title")).alias("title"), F.col("created").cast("timestamp").alias("created"))

    def apply(change: Change) -> None:
        held = change.read("files", FILES)
        _refuse(rows.where(blank(F.col("title"))), "a title must not be empty")
        _refuse(rows.join(held, "file_id", "left_semi"), "the history is there already")
        named = _names(rows.withColumn("stem", history_name(F.col("created"), F.col("title"))), held)
        change.upsert("files", named.select("file_id", "title", "filename", "created", F.col("created").alias("updated")), "file_id")

    return store.change(apply)


def append(store: Store, records: DataFrame, at: Column) -> int:
    """Records of histories that are there, and the histories' time of change, together."""

    def apply(change: Change) -> None:
        held = change.read("files", FILES)
        _refuse(records.select(F.col("file_id").cast("string").alias("file_id")).distinct().join(held, "file_id", "left_anti"), "no such history")
        change.upsert("records", records.withColumn("file_id", F.col("file_id").cast("string")), "record_id")
        change.upsert("files", held.join(records.select("file_id").distinct(), "file_id", "left_semi").withColumn("updated", at.cast("timestamp")).select(*held.columns))

    return store.change(apply)


def rename(store: Store, names: DataFrame, at: Column) -> int:
    """New titles of (file_id, title). A file name keeps its time; unknown ids and blank titles are errors."""
    rows = names.select(F.col("file_id").cast("string").alias("file_id"), strip(F.col("title")).alias("new_title"))

    def apply(change: Change) -> None:
        held = change.read("files", FILES)
        _refuse(rows.where(blank(F.col("new_title"))), "a title must not be empty")
        _refuse(rows.join(held, "file_id", "left_anti"), "no such history")
        stem = F.concat_ws("-", F.substring("filename", 1, PREFIX), safe_title(F.col("new_title"), "Memory"))
        renamed = _names(held.join(rows, "file_id").withColumn("stem", stem), held.select("filename"))
        change.upsert("files", renamed.select("file_id", F.col("new_title").alias("title"), "filename", "created", at.cast("timestamp").alias("updated")))

    return store.change(apply)


def delete(store: Store, gone: DataFrame) -> DataFrame:
    """Histories with their records and vectors; file_id, records_deleted, vectors_deleted of what went. Unknown ids are errors."""
    keys = gone.select(F.col("file_id").cast("string").alias("file_id")).distinct()
    spark, counted = store.spark, []

    def apply(change: Change) -> None:
        held = change.read("files", FILES)
        _refuse(keys.join(held, "file_id", "left_anti"), "no such history")
        counts = keys
        for table in ("records", "vectors"):
            if table in change.state:
                rows = change.read(table).join(keys, "file_id", "left_semi")
                counts = counts.join(rows.groupBy("file_id").agg(F.count("*").alias(f"{table}_deleted")), "file_id", "left")
                change.delete(table, rows.select("record_id"))
            else:
                counts = counts.withColumn(f"{table}_deleted", F.lit(0))
        counted[:] = [tuple(r) for r in counts.select("file_id", *(F.coalesce(f"{t}_deleted", F.lit(0)).cast("long") for t in ("records", "vectors"))).collect()]  # the request's files
        change.delete("files", keys)

    store.change(apply)
    return spark.createDataFrame(counted, "file_id string, records_deleted long, vectors_deleted long")


def listing(store: Store, n: int | None = None) -> DataFrame:
    """Histories, the last changed first, with their number of records."""
    files = store.read("files", schema=FILES)
    held = store.read("records", schema="file_id string").groupBy("file_id").agg(F.count("*").alias("n_records"))
    rows = files.join(held, "file_id", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    ordered = rows.orderBy(F.desc("updated"), "file_id")
    return ordered if n is None else ordered.limit(n)


def ingest_all(store: Store, entries: Callable[[DataFrame], DataFrame], only: DataFrame | None = None) -> DataFrame:
    """Make the vectors of all records anew, or of some files' (file_id), in one commit.

    ``entries`` takes records and gives (record_id, vector_id, file_id and others). A record without entries loses its
    vectors and succeeds; one with a blank id fails. Returns file_id, total, success_count, failure_count,
    vectors_deleted, vectors_written and success: a file succeeds if none of its records failed.
    """
    spark, done = store.spark, []

    def apply(change: Change) -> None:
        records = change.read("records")
        if only is not None:
            records = records.join(only.select(F.col("file_id").cast("string").alias("file_id")).distinct(), "file_id", "left_semi")
        usable = records.where(~blank(F.col("record_id")))
        made = entries(usable)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
        old = change.read("vectors", kinds).join(usable.select("record_id").distinct(), "record_id", "left_semi")
        per = lambda df, name: df.groupBy("file_id").agg(F.count("*").alias(name))
        ok = F.count_if(~blank(F.col("record_id")))
        result = records.groupBy("file_id").agg(F.count("*").alias("total"), ok.alias("success_count"), (F.count("*") - ok).alias("failure_count"))
        result = result.join(per(old, "vectors_deleted"), "file_id", "left").join(per(made, "vectors_written"), "file_id", "left").fillna(0, ["vectors_deleted", "vectors_written"])
        done[:] = [result.withColumn("success", F.col("failure_count") == 0)]
        done[0] = spark.createDataFrame(done[0].toArrow())  # counts of this change's state, a row per file
        if "vectors" in change.state:
            change.delete("vectors", usable.select("record_id"))
        change.upsert("vectors", made, "record_id")

    store.change(apply)
    return done[0]
