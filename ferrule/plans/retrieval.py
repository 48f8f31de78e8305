"""Queries of dense, sparse and fused retrieval over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..functions.text import once
from ..operators import ingest, late_interaction, retrieval, sparse_index
from ..sources.commits import Store
from .derived import kept
from .ingest import CHUNKS
from .registry import query, table

PIECES, BUCKETS = (0, 1, 2), 256


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id").isin(*PIECES)).select("vector")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def terms(docs: DataFrame, id_col: str, *more: str) -> DataFrame:
    """id, term, weight and further columns: words hashed to buckets, weighted 1 + ln(tf); a deterministic stand-in for a learned sparse encoder.

    Ids are unique: a text's terms are counted in its own row, as runs of its sorted buckets, and nothing is shuffled.
    """
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % BUCKETS
    ends = lambda b: F.filter(F.sequence(F.lit(1), F.size(b)), lambda i: (i == F.size(b)) | (F.get(b, i) != F.get(b, i - 1)))
    run = lambda b, e, i: F.struct(F.get(b, F.get(e, i) - 1).alias("term"), (F.get(e, i) - F.when(i == 0, 0).otherwise(F.get(e, i - 1))).alias("n"))
    runs = once(F.array_sort(F.transform(words, bucket)), lambda b: F.when(F.size(b) > 0, once(ends(b), lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 1), lambda i: run(b, e, i)))))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("t"), *more)
    return rows.select("id", F.col("t.term").alias("term"), (F.lit(1.0) + F.log(F.col("t.n").cast("long"))).alias("weight"), *more)


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(table(spark, sf_dir, "benchmark").where("item_id < 3"), "item_id").withColumnRenamed("id", "piece")


DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
NORM = "(sqrt(" + DOT + ") + 1e-12)"
COS = f"({DOT.format(a='e.embedding', b='q.embedding')} / ({NORM.format(a='e.embedding', b='e.embedding')} * {NORM.format(a='q.embedding', b='q.embedding')}))"
DENSE = f"SELECT e.vec_id AS id, pow(avg(pow(greatest({COS}, 0), 10)), 0.1) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (0, 1, 2)) q GROUP BY 1"
DENSE_TOP = f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({DENSE}) ORDER BY 3 LIMIT 100"
WORDS = "SELECT {id} AS id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 256 AS term FROM (SELECT {id}, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM {t}) WHERE word <> ''"
TERMS = "SELECT id, term, 1 + ln(count(*)) AS weight FROM ({w}) GROUP BY 1, 2"
DOC_TERMS = TERMS.format(w=WORDS.format(id="doc_id", t="documents"))
QUERY_TERMS = TERMS.format(w=WORDS.format(id="item_id", t="benchmark WHERE item_id < 3"))
SPARSE = f"""SELECT id, pow(sum(pow(greatest(dot, 0), 10)) / (SELECT count(DISTINCT id) FROM ({QUERY_TERMS})), 0.1) AS score
FROM (SELECT d.id, q.id AS piece, sum(d.weight * q.weight) AS dot FROM ({DOC_TERMS}) d JOIN ({QUERY_TERMS}) q USING (term) GROUP BY 1, 2) GROUP BY 1"""
SPARSE_TOP = f"SELECT id, score, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM ({SPARSE}) ORDER BY 3 LIMIT 100"
RRF = """SELECT coalesce(a.id, b.id) AS id, a.rank AS rank_a, b.rank AS rank_b, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce({w}::DOUBLE / (60 + b.rank), 0) AS rrf_score FROM ({a}) a FULL JOIN ({b}) b ON a.id = b.id"""


def dense_list(spark, sf_dir, k: int = 100) -> DataFrame:
    return retrieval.ranked(retrieval.dense_scores(vectors(spark, sf_dir), pieces(spark, sf_dir)), k)


def sparse_store(spark, sf_dir) -> Store:
    """The inverted index of all documents; written by the first query that asks for it."""
    docs = lambda: table(spark, sf_dir, "documents")
    return kept(spark, sf_dir, ("documents",), "postings", lambda store: sparse_index.build(terms(docs(), "doc_id", "lang"), store, "postings", by=("lang",)))


def sparse_list(spark, sf_dir, k: int = 100) -> DataFrame:
    return sparse_index.search(sparse_store(spark, sf_dir), "postings", query_terms(spark, sf_dir), k)


@query(f"SELECT e.vec_id AS id, round({COS}, 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY {COS} DESC, 1 LIMIT 20")
def dense_cosine_topk(spark, sf_dir):
    stored = vectors(spark, sf_dir)
    one = stored.where("id = 0").select(F.col("vector").alias("query"))
    scored = stored.crossJoin(F.broadcast(one)).select("id", vec.cosine_eps(F.col("vector"), F.col("query")).alias("score"))
    return rounded(retrieval.top(scored, 20), "score")


@query(f"SELECT id, round(score, 6) AS score, rank FROM ({DENSE_TOP})")
def dense_pnorm_multi(spark, sf_dir):
    return rounded(dense_list(spark, sf_dir), "score")


@query(f"SELECT id, round(score, 6) AS score, rank FROM ({DENSE_TOP}) WHERE score >= 0.2")
def dense_floor(spark, sf_dir):
    return rounded(retrieval.floor(dense_list(spark, sf_dir)), "score")


@query("""SELECT id, round(1 / (1 + d), 6) AS score FROM (SELECT e.vec_id AS id, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: pow(CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE), 2))) AS d
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q) ORDER BY d, id LIMIT 20""")
def dist_score_topk(spark, sf_dir):
    stored = vectors(spark, sf_dir)
    one = stored.where("id = 0").select(F.col("vector").alias("query"))
    scored = stored.crossJoin(F.broadcast(one)).select("id", vec.distance_score(vec.squared_distance(F.col("vector"), F.col("query"))).alias("score"))
    return rounded(retrieval.top(scored, 20), "score")


@query("SELECT label, CAST(dim AS BIGINT) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings) GROUP BY 1, 2")
def centroid_by_label(spark, sf_dir):
    return rounded(retrieval.labelled_centroids(vectors(spark, sf_dir), "label"), "mean")


@query(f"""SELECT label, round(list_avg(list_slice(s, 1, CASE WHEN n <= 4 THEN n WHEN n <= 20 THEN 4 ELSE greatest(1, n // 5) END)), 6) AS score
FROM (SELECT e.label, list_reverse_sort(list({COS})) AS s, count(*) AS n FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q GROUP BY 1)""")
def top_mean_by_label(spark, sf_dir):
    """A label's scores are ranked in a window and cut, not gathered in one array."""
    from pyspark.sql import Window

    stored = vectors(spark, sf_dir)
    one = stored.where("id = 0").select(F.col("vector").alias("query"))
    scored = stored.crossJoin(F.broadcast(one)).select("id", "label", vec.cosine_eps(F.col("vector"), F.col("query")).alias("score"))
    n = F.count("*").over(Window.partitionBy("label"))
    take = F.when(n <= 4, n).when(n <= 20, 4).otherwise(F.greatest(F.lit(1), F.floor(n / 5)))
    placed = scored.withColumns({"i": F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id")), "take": take})
    return rounded(placed.where("i <= take").groupBy("label").agg(F.avg("score").alias("score")), "score")


@query(f"SELECT label, count(*) AS n, round(min(s), 6) AS least, round(max(s), 6) AS most, round(avg(s), 6) AS mean FROM (SELECT e.label, {COS} AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q) GROUP BY 1")
def score_summary(spark, sf_dir):
    stored = vectors(spark, sf_dir)
    one = stored.where("id = 0").select(F.col("vector").alias("query"))
    scored = stored.crossJoin(F.broadcast(one)).select("label", vec.cosine_eps(F.col("vector"), F.col("query")).alias("s"))
    return rounded(scored.groupBy("label").agg(F.count("*").alias("n"), F.min("s").alias("least"), F.max("s").alias("most"), F.avg("s").alias("mean")), "least", "most", "mean")


@query(f"SELECT id, round(score, 6) AS score, rank FROM ({SPARSE_TOP})")
def sparse_pnorm(spark, sf_dir):
    return sparse_list(spark, sf_dir)


@query(f"SELECT d.id, round(sum(d.weight * q.weight), 6) AS score FROM ({DOC_TERMS}) d JOIN ({QUERY_TERMS}) q ON d.term = q.term AND q.id = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def sparse_tf_dot_topk(spark, sf_dir):
    one = query_terms(spark, sf_dir).where("piece = 0")
    return sparse_index.search(sparse_store(spark, sf_dir), "postings", one, 20).select("id", "score")


@query(f"SELECT s.id, round(s.score, 6) AS score FROM ({SPARSE}) s WHERE s.id IN (SELECT id FROM ({DENSE_TOP}))")
def sparse_candidate_semi(spark, sf_dir):
    """Postings of the request's terms, of the candidates alone, before anything is summed."""
    candidates = F.broadcast(dense_list(spark, sf_dir).select("id"))  # a hundred
    return rounded(sparse_index.scores(sparse_store(spark, sf_dir), "postings", query_terms(spark, sf_dir), candidates=candidates), "score")


@query(f"SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM ({DOC_TERMS}))")
def sparse_missing_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return retrieval.missing(docs.select(F.col("doc_id").alias("id")), terms(docs, "doc_id"))


@query(f"SELECT id, rank_a, rank_b, round(rrf_score, 9) AS rrf_score FROM ({RRF.format(a=DENSE_TOP, b=SPARSE_TOP, w='1.0')}) ORDER BY rrf_score DESC, id LIMIT 50")
def rrf_hybrid(spark, sf_dir):
    fused = retrieval.rrf(dense_list(spark, sf_dir), sparse_list(spark, sf_dir), top_k=50)
    return fused.select("id", "rank_a", "rank_b", F.round("rrf_score", 9).alias("rrf_score"))


@query(f"SELECT id, rank_a AS emb_rank, rank_b AS splade_rank, round(rrf_score, 9) AS rrf_score FROM ({RRF.format(a=DENSE_TOP, b=SPARSE_TOP, w='0.5')})")
def rank_contract(spark, sf_dir):
    fused = retrieval.rename_contract(retrieval.rrf(dense_list(spark, sf_dir), sparse_list(spark, sf_dir), weight_b=0.5), "emb", "splade")
    return fused.select("id", "emb_rank", "splade_rank", F.round("rrf_score", 9).alias("rrf_score"))


FUSED = RRF.format(a=DENSE_TOP, b=SPARSE_TOP, w="1.0")


@query(f"SELECT id, round(rrf_score, 9) AS rerank_rrf_score FROM ({FUSED}) ORDER BY rrf_score DESC, id LIMIT 50")
def rrf_passthrough(spark, sf_dir):
    fused = retrieval.passthrough(retrieval.rrf(dense_list(spark, sf_dir), sparse_list(spark, sf_dir)))
    return fused.select("id", F.round("rerank_rrf_score", 9).alias("rerank_rrf_score"))


BAND = f"SELECT id, row_number() OVER (ORDER BY rrf_score DESC, id) AS rank FROM ({FUSED}) ORDER BY 2 LIMIT 50"
SECOND = f"""SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT e.vec_id AS id, round(avg({COS}), 9) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (0, 1, 2)) q
WHERE e.vec_id IN (SELECT id FROM ({BAND})) GROUP BY 1)"""


@query(f"SELECT id, rank_a AS retrieval_rank, rank_b AS colbert_rank, round(rrf_score, 9) AS rerank_rrf_score FROM ({RRF.format(a=BAND, b=SECOND, w='1.0')}) ORDER BY rrf_score DESC, id LIMIT 50")
def rrf_rerank_fusion(spark, sf_dir):
    """The second stage compares the band's vectors alone with those of the pieces."""
    query_vectors = vectors(spark, sf_dir).where(F.col("id").isin(*PIECES)).select(F.col("id").alias("piece"), F.col("vector").alias("query"))

    def second(band: DataFrame) -> DataFrame:
        own = vectors(spark, sf_dir).join(F.broadcast(band), "id", "left_semi")  # fifty
        return own.crossJoin(F.broadcast(query_vectors)).select("id", "piece", vec.cosine_eps(F.col("vector"), F.col("query")).alias("score"))

    out = retrieval.rerank(retrieval.rrf(dense_list(spark, sf_dir), sparse_list(spark, sf_dir)), second)
    return out.select("id", "retrieval_rank", "colbert_rank", F.round("rerank_rrf_score", 9).alias("rerank_rrf_score"))


@query(f"SELECT s.id, s.rank, c.chunk_idx, c.start, c.chunk FROM ({SPARSE_TOP}) s JOIN ({CHUNKS}) c ON c.doc_id = s.id WHERE s.rank <= 10")
def hydrate_topk(spark, sf_dir):
    """Ten documents are picked, then chunked."""
    best = sparse_list(spark, sf_dir, 10).select(F.col("id").alias("doc_id"), "rank")
    chosen = retrieval.hydrate(F.broadcast(best), table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return ingest.chunk_rows(chosen, ["doc_id", "rank"]).select(F.col("doc_id").alias("id"), "rank", "chunk_idx", "start", "chunk")


@query(f"""SELECT f.id, f.rank_a, f.rank_b, round(f.rrf_score, 9) AS rrf_score, d.source, d.text
FROM (SELECT * FROM ({FUSED}) ORDER BY rrf_score DESC, id LIMIT 30) f JOIN documents d ON d.doc_id = f.id""")
def hybrid_retrieval_e2e(spark, sf_dir):
    """The flagship: dense and sparse lists, fused, cut and joined with their documents."""
    fused = retrieval.rrf(dense_list(spark, sf_dir), sparse_list(spark, sf_dir), top_k=30)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return docs.join(F.broadcast(fused), "id").select("id", "rank_a", "rank_b", F.round("rrf_score", 9).alias("rrf_score"), "source", "text")


def token_store(spark, sf_dir) -> Store:
    docs = lambda: table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return kept(spark, sf_dir, ("documents",), "tokens", lambda store: late_interaction.build(docs(), store, "matrices"))


_WORDS = "list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda w: w <> '')"
_RAW = "list_transform({w}, lambda w: list_transform(range(0, 16), lambda i: ('0x' || substr(md5(w), 2 * i + 1, 2))::BIGINT - 127.5::DOUBLE))"
_UNIT = "list_transform({m}, lambda v: list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))))"
_TOKENS = lambda t, w: _UNIT.format(m=_RAW.format(w=w.format(w=_WORDS.format(t=t))))
MAX_SIM = f"""SELECT d.id, p.piece, list_sum(list_transform(q, lambda a: list_max(list_transform(m, lambda b: list_inner_product(a, b))))) AS score
FROM (SELECT doc_id AS id, {_TOKENS("text", "list_distinct({w})")} AS m FROM documents WHERE doc_id IN (SELECT id FROM ({BAND}))) d, (SELECT item_id AS piece, {_TOKENS("text", "{w}")} AS q FROM benchmark WHERE item_id < 3) p WHERE len(m) > 0"""


def max_sims(spark, sf_dir, band: DataFrame) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").where("item_id < 3").select(F.col("item_id").alias("piece"), "text")
    return late_interaction.max_sim(token_store(spark, sf_dir), "matrices", asked, band)


@query(f"SELECT id, piece, round(score, 6) AS score FROM ({MAX_SIM})")
def late_interaction_scores(spark, sf_dir):
    """MaxSim of the request's pieces with the token matrices of the first stage's fifty best."""
    band = retrieval.rrf(dense_list(spark, sf_dir), sparse_list(spark, sf_dir), top_k=50)
    return rounded(max_sims(spark, sf_dir, band), "score")


LATE = f"SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(avg(score), 9) AS score FROM ({MAX_SIM}) GROUP BY 1)"


@query(f"SELECT id, rank_a AS retrieval_rank, rank_b AS colbert_rank, round(rrf_score, 9) AS rerank_rrf_score FROM ({RRF.format(a=BAND, b=LATE, w='1.0')}) ORDER BY rrf_score DESC, id LIMIT 50")
def late_interaction_rerank(spark, sf_dir):
    """The two stages fused: rank of the first stage, and of the mean of the pieces' MaxSim."""
    out = retrieval.rerank(retrieval.rrf(dense_list(spark, sf_dir), sparse_list(spark, sf_dir)), lambda band: max_sims(spark, sf_dir, band))
    return out.select("id", "retrieval_rank", "colbert_rank", F.round("rerank_rrf_score", 9).alias("rerank_rrf_score"))


@query(f"""SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
SELECT s.id, round(s.score, 6) AS score FROM ({SPARSE}) s JOIN documents d ON d.doc_id = s.id WHERE d.lang = 'de') ORDER BY 3 LIMIT 100""")
def sparse_filtered_topk(spark, sf_dir):
    """The best of one language: the filter is met inside the index, whose blocks say which languages they hold."""
    return sparse_index.search(sparse_store(spark, sf_dir), "postings", query_terms(spark, sf_dir), 100, {"lang": "de"})
