"""A corpus pipeline over ``documents``: five stages, each one operator over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Every stage takes nulls in any column, empty texts, texts of any length that a task can hold, repeated rows and
ids, further columns (whatever their names, in whatever case, they pass unchanged to the last stage, which leaves
them behind: each stage works on its own columns with all others set aside) and empty tables; what becomes of each is said at the stage. An empty labels table leaves every score at 0.5, so all
documents stay; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import aside, drop, scratch, table
from ferrule.llm.decontaminate import remove_contaminated
from ferrule.llm.linededup import drop_boilerplate
from ferrule.llm.neardup import one_of_each
from ferrule.llm.pieces import encode_decode
from ferrule.llm.quality import held_out, score_quality, train


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def on_own_columns(stage: Stage) -> Stage:
    """The stage, with the caller's further columns out of its way."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own, back = aside(docs, "doc_id", "text", "lang", "source", "n_chars")
        return back(stage(spark, own, sf_dir))

    return run


@on_own_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: a score under 0.5.

    Null and empty texts are scored as one empty line; equal texts score alike; ids have no part in it but for
    the held-out rule (a null id isn't held out), and labels of null ids aren't learnt from.
    """
    field = train(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return score_quality(docs, field, out="score_").where("score_ >= 0.5").select(docs.columns)


@on_own_columns
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every document stays, and n_chars follows its text.

    A document of nothing but such lines is a copy, which the next stage is for: it stays as it is here, so that
    different groups of copies don't become one group of empty texts. A null source is a source of its own;
    a null text stays null, and so does its n_chars. Repeated rows count as documents of their own.
    """
    return drop_boilerplate(docs, keep_copies=True).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@on_own_columns
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id (null ids last).

    Null and empty texts are equal, so one of all these stays; of rows equal in doc_id and text one stays.
    """
    return one_of_each(docs)


@on_own_columns
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim match of ten benchmark words, or of a whole shorter item, go; null and empty texts stay."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@on_own_columns
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text; a null text is an empty one, without ids."""
    encoded = encode_decode(docs.withColumn("text", F.coalesce("text", F.lit(""))), ids_out="ids", decoded_out="decoded_")
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded_") == F.col("text")).alias("exact"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("decontamination", decontamination), ("pieces", pieces)]

#: Not expressible in SQL (a trained field, signatures, a tokenizer): tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs
