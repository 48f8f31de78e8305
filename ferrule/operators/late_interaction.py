"""Late interaction: a matrix of token vectors per text, kept in a table, and MaxSim on the rows of a band.

A token's vector is the sixteen bytes of its md5 less their middle, at length 1: a deterministic stand-in for a
learned token encoder, and as compact as its matrices are usually kept, a byte a number. A text's matrix has its
distinct tokens, as a maximum over tokens doesn't need repeats. Matrices are made once; a request reads those of its
band, by bucket folder and id, and none else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.commits import Store

DIMS, BUCKETS = 16, 32
#: A band is a request's: it is collected, and so are the pieces.
MOST_BAND = 10_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def matrix(text: Column, distinct: bool = True) -> Column:
    """Bytes of the token vectors, one after another."""
    words = F.array_distinct(tokens(text)) if distinct else tokens(text)
    return F.unhex(F.array_join(F.transform(words, F.md5), ""))


def _bucket(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(BUCKETS)).cast("int")


def build(texts: DataFrame, store: Store, name: str) -> None:
    """Write the matrices of (id, text), each by the task that makes it. A text without tokens, or a null one, has an empty matrix."""
    rows = texts.where("id IS NOT NULL").select(_bucket(F.col("id")).alias("bucket"), "id", matrix(F.col("text")).alias("matrix"))
    store.change(lambda c: c.replace(name, rows.sortWithinPartitions("bucket", "id"), key="id", partition_by=("bucket",)))


def add(store: Store, name: str, texts: DataFrame) -> None:
    """Put matrices in, in place of those with their ids."""
    rows = texts.where("id IS NOT NULL").select(_bucket(F.col("id")).alias("bucket"), "id", matrix(F.col("text")).alias("matrix"))
    store.change(lambda c: c.upsert(name, rows))


def unit(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).astype(np.float64).reshape(-1, DIMS) - 127.5
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def max_sim(store: Store, name: str, pieces: DataFrame, band: DataFrame) -> DataFrame:
    """id, piece, score: for each token of a piece (piece, text) the cosine of the text's most similar token, summed.

    Ids without a matrix, or with an empty one, aren't scored; a piece without tokens scores 0.
    """
    spark = pieces.sparkSession
    ids = [r[0] for r in band.select("id").distinct().limit(MOST_BAND + 1).collect()]
    if len(ids) > MOST_BAND:
        raise ValueError("a band of this size isn't one request's")
    stored = store.read(name)
    asked = [(r[0], unit(bytes(r[1]))) for r in pieces.select("piece", matrix(F.col("text"), distinct=False)).collect()]
    given, kind = spark.sparkContext.broadcast(asked), pieces.schema["piece"].dataType.simpleString()
    piece_type = pa.string() if kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [[float((q @ d.T).max(axis=1).sum()) if len(q) else 0.0 for _, q in given.value] for d in map(unit, batch.column("matrix").to_pylist())]
            n = len(given.value)
            names = pa.array([p for p, _ in given.value] * batch.num_rows, piece_type)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), n))), names, pa.array([x for row in score for x in row], pa.float64())], names=["id", "piece", "score"])

    if not ids:
        rows = stored.limit(0)
    else:
        kind_id = stored.schema["id"].dataType.simpleString()
        buckets = [r[0] for r in spark.createDataFrame([(i,) for i in ids], f"id {kind_id}").select(_bucket(F.col("id"))).distinct().collect()]
        rows = stored.where(F.col("bucket").isin(buckets) & F.col("id").isin(ids) & (F.length("matrix") > 0))
    return rows.select("id", "matrix").mapInArrow(run, f"id {stored.schema['id'].dataType.simpleString()}, piece {'string' if kind == 'string' else 'long'}, score double")
