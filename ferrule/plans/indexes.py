"""Queries of the stored indexes and of tables that change by commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import vectors as vec
from ..operators import dense_index, histories, tokens
from ..sources.commits import Store
from ..sources.shared import shared_dir
from .derived import kept
from .memory import RECS, recs
from .registry import query, table
from .retrieval import COS, rounded, vectors


def dense_store(spark: SparkSession, sf_dir: str) -> Store:
    """The inverted-file index of all embeddings; written by the first query that asks for it."""
    return kept(spark, sf_dir, ("embeddings",), "cells", lambda store: dense_index.build(vectors(spark, sf_dir), store, "cells"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20, against all rows."""
    return vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


NEAREST = f"""SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 12) DESC, e.vec_id) AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 {{more}}) WHERE rank <= {{k}}"""


@query(NEAREST.format(more="", k=10))
def ivf_exact_topk(spark, sf_dir):
    """All cells: the exact ten nearest."""
    return rounded(dense_index.search(dense_store(spark, sf_dir), "cells", asked(spark, sf_dir), 10), "score")


@query(NEAREST.format(more="AND e.label = 3", k=10))
def ivf_filtered_topk(spark, sf_dir):
    """The nearest of one label; others aren't scored."""
    return rounded(dense_index.search(dense_store(spark, sf_dir), "cells", asked(spark, sf_dir), 10, spec={"label": 3}), "score")


@query()
def ivf_topk(spark, sf_dir):
    """The hundred nearest among as many cells as the measured recall asks for."""
    store = dense_store(spark, sf_dir)
    return rounded(dense_index.search(store, "cells", asked(spark, sf_dir), 100, dense_index.probes_for(store, "cells", 100)), "score")


@query(NEAREST.format(more="", k=10))
def ivf_upserted_topk(spark, sf_dir):
    """An index of most vectors, some of them wrong, into which the right ones are put afterwards."""
    store, own = Store(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"), vectors(spark, sf_dir)
    late = F.col("id") % 10 == 3
    wrong = F.when(F.col("id") % 10 == 4, F.transform("vector", lambda x: -x)).otherwise(F.col("vector"))
    dense_index.build(own.where(~late).withColumn("vector", wrong), store, "cells")
    dense_index.add(store, "cells", own.where(late | (F.col("id") % 10 == 4)))
    return rounded(dense_index.search(store, "cells", asked(spark, sf_dir), 10), "score")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 5 <> 1")
def store_upserts(spark, sf_dir):
    """Texts written, some changed, some deleted, folded, and changed once more, by one commit each."""
    store, docs = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), table(spark, sf_dir, "documents").select("doc_id", "text")
    store.change(lambda c: c.upsert("texts", docs.where("doc_id % 11 <> 0"), "doc_id"))
    store.change(lambda c: c.upsert("texts", docs.where("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit("?")))))
    store.change(lambda c: c.delete("texts", docs.where("doc_id % 5 = 1")))
    store.compact("texts")
    store.change(lambda c: c.upsert("texts", docs.where("(doc_id % 7 = 0 OR doc_id % 11 = 0) AND doc_id % 5 <> 1").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))))
    return store.read("texts").select("doc_id", F.sha2("text", 256).alias("sha"))


CREATED = "2024-03-04 05:06:00"


def _histories(spark, sf_dir) -> Store:
    """A history per conversation, with its records; vectors of every record's question and answer."""
    store = Store(spark, f"{shared_dir(spark)}/histories-{uuid.uuid4().hex}")
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_id")).distinct()
    histories.create(store, ids.select("file_id", F.concat(F.lit(" Talk: "), "file_id").alias("title"), F.lit(CREATED).cast("timestamp").alias("created")))
    histories.append(store, recs(spark, sf_dir).select("record_id", F.col("file_id").cast("string").alias("file_id"), "ordinal", "input_text", "output_text"), F.lit(CREATED).cast("timestamp"))
    return store


def _entries(records: DataFrame) -> DataFrame:
    role = F.explode(F.array(F.lit("question"), F.lit("answer")))
    return records.where("ordinal % 10 <> 4").select("record_id", "file_id", role.alias("role")).select("record_id", F.concat_ws("::", "record_id", "role").alias("vector_id"), "file_id")


ALL_RECS = f"(SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN {RECS} r ON r.file_id = c.conv_id"


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS file_id, CASE WHEN conv_id % 3 = 0 THEN 'A new name' ELSE 'Talk: ' || conv_id END AS title,
CASE WHEN conv_id % 3 <> 0 THEN '2024-03-04-05-06-Talk-' || conv_id WHEN conv_id = (SELECT min(CAST(conv_id AS VARCHAR)) FROM conversations WHERE conv_id % 3 = 0 AND conv_id % 4 <> 1) THEN '2024-03-04-05-06-A-new-name' ELSE '2024-03-04-05-06-A-new-name-' || conv_id END AS filename,
count(r.record_id) AS n_records, count(r.record_id) FILTER (ordinal % 10 <> 4) * 2 AS n_vectors FROM {ALL_RECS} WHERE conv_id % 4 <> 1 GROUP BY conv_id""")
def hist_crud(spark, sf_dir):
    """Histories created, filled, ingested, some deleted with all they have, some renamed alike."""
    store = _histories(spark, sf_dir)
    histories.ingest_all(store, _entries)
    ids = store.read("files").select("file_id")
    histories.delete(store, ids.where("CAST(file_id AS LONG) % 4 = 1"))
    histories.rename(store, ids.where("CAST(file_id AS LONG) % 4 <> 1 AND CAST(file_id AS LONG) % 3 = 0").withColumn("title", F.lit("A new name ")), F.lit(CREATED).cast("timestamp"))
    vectors_of = store.read("vectors").groupBy("file_id").agg(F.count("*").alias("n_vectors"))
    return histories.listing(store).join(vectors_of, "file_id", "left").select("file_id", "title", "filename", "n_records", F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))


@query(f"""SELECT CAST(file_id AS VARCHAR) AS file_id, count(*) AS total, count(*) AS success_count, CAST(0 AS BIGINT) AS failure_count, count(*) FILTER (ordinal % 10 <> 4) * 2 AS vectors_deleted, count(*) FILTER (ordinal % 10 <> 4) * 2 AS vectors_written, true AS success
FROM {RECS} WHERE file_id % 2 = 0 GROUP BY 1""")
def mem_ingest_all(spark, sf_dir):
    """Half of the histories ingested a second time: their vectors are replaced, per file."""
    store = _histories(spark, sf_dir)
    histories.ingest_all(store, _entries)
    return histories.ingest_all(store, _entries, store.read("files").where("CAST(file_id AS LONG) % 2 = 0").select("file_id"))


def ranks() -> tokens.Ranks | None:
    """The rank file of a public tokenizer, where the machine has it; else counts are estimates."""
    try:
        import public_tokenizers
    except ImportError:
        return None
    return tokens.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def word_store(spark, sf_dir) -> Store:
    texts = lambda name: table(spark, sf_dir, name).select("text")
    return kept(spark, sf_dir, ("documents", "conversations"), "words", lambda store: [tokens.learn(store, "words", texts(t), own) for t in ("documents", "conversations") if (own := ranks())])


@query()
def token_counts(spark, sf_dir):
    """Real counts of every document, by the table of distinct words."""
    return tokens.counts(table(spark, sf_dir, "documents").select("doc_id", "text"), word_store(spark, sf_dir), ranks(), key="doc_id")


@query()
def qa_budget_tokens(spark, sf_dir):
    """The budgets of question and answer by real counts, beside those by estimates."""
    rows, store = recs(spark, sf_dir).select("record_id", "input_text", "output_text"), word_store(spark, sf_dir)
    side = lambda column, name: tokens.counts(rows.select("record_id", F.col(column).alias("text")), store, ranks(), key="record_id").withColumnRenamed("n_tokens", name)
    counted = rows.join(side("input_text", "question_tokens"), "record_id").join(side("output_text", "answer_tokens"), "record_id")
    real = vec.qa_budget(F.col("question_tokens"), F.col("answer_tokens"), 500, 150)
    estimated = vec.qa_budget(fn.token_estimate(F.col("input_text")), fn.token_estimate(F.col("output_text")), 500, 150)
    return counted.select("record_id", "question_tokens", "answer_tokens", real[0].alias("question_budget"), real[1].alias("answer_budget"), estimated[0].alias("estimated_question"), estimated[1].alias("estimated_answer"))
