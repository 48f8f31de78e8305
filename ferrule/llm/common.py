"""Shared plumbing of the training-data operators: inputs, scratch tables, Arrow slices."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Shuffle files of a finished write are of no further use; Spark removes them when this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns asked for; others, clashing names included, are left behind."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but those used (in any case, as Spark compares names) under names that no operator has, and a function that names them back."""
    kept = {u.lower() for u in used}
    names = {c: f"aside_{i}_of_caller" for i, c in enumerate(docs.columns) if c.lower() not in kept}
    return docs.withColumnsRenamed(names), lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def scratch(df: DataFrame, tag: str, codec: str = "zstd", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ferrule-{tag}-{uuid.uuid4().hex}"
    with shuffle_cleanup(spark):
        df.write.option("compression", codec).partitionBy(*partition_by).parquet(path)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._ferrule_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables whose rows have been used up."""
    for t in tables:
        if path := getattr(t, "_ferrule_path", None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if (spark, path) in _scratch:
        _scratch.remove((spark, path))


@atexit.register
def release() -> None:
    """Delete the scratch tables that results of this session still hold; call it once these are written."""
    for spark, path in list(_scratch):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone at exit
            _scratch.remove((spark, path))


def slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose values in ``column`` take about ``limit`` bytes, one row at least."""
    col = batch.column(column)
    sizes = pa.compute.binary_length(col).fill_null(0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)
