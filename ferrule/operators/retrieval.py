"""Dense, sparse and fused ranking. Scores of ties are ordered by id, so results are the same everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from ..functions.vectors import POWER, cosine_eps

RRF_K, FLOOR, DEFAULT_K = 60, 0.2, 100
#: Query pieces are vectors of one request; more than this many aren't broadcast, but meet the vectors in blocks.
BROADCAST_PIECES, BLOCK_PIECES = 10_000, 1_000


def top(scored: DataFrame, k: int | None, id_col: str = "id", score: str = "score") -> DataFrame:
    """By score, then id; at most k rows; no limit where k is None, the default where it isn't positive."""
    ordered = scored.orderBy(F.desc(score), F.asc(id_col))
    return ordered if k is None else ordered.limit(k if k > 0 else DEFAULT_K)


def ranked(scored: DataFrame, k: int, id_col: str = "id", score: str = "score") -> DataFrame:
    """The top k with their 1-based rank. Only those k rows meet in one task."""
    return top(scored, k, id_col, score).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(id_col))).cast("long"))


def dense_scores(stored: DataFrame, pieces: DataFrame, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """id, score: power mean over query pieces of the similarity to each.

    Pieces go to the vectors: they are gathered into one array, so stored vectors are neither
    multiplied in number nor shuffled. Pieces too many for that are counted, equal ones once, and go as
    blocks: a vector then meets one row per block, and only its sums, a number each, are shuffled.
    """
    power = lambda q: F.pow(F.greatest(cosine_eps(F.col(vector), q), F.lit(0.0)), F.lit(POWER))
    if pieces.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES:
        query = pieces.agg(F.collect_list(vector).alias("pieces_"))
        mean = F.aggregate("pieces_", F.lit(0.0), lambda s, q: s + power(q)) / F.size("pieces_")
        return stored.crossJoin(F.broadcast(query)).where(F.size("pieces_") > 0).select(id_col, F.pow(mean, F.lit(1.0 / POWER)).alias("score"))
    n = pieces.count()
    counted = pieces.groupBy(F.col(vector).alias("piece_")).agg(F.count("*").alias("n_"))
    block = F.pmod(F.xxhash64("piece_"), F.lit(-(-n // BLOCK_PIECES))).alias("block_")
    blocks = counted.groupBy(block).agg(F.collect_list(F.struct("piece_", "n_")).alias("pieces_")).drop("block_")
    part = F.aggregate("pieces_", F.lit(0.0), lambda s, q: s + q["n_"] * power(q["piece_"]))
    parts = stored.select(id_col, vector).crossJoin(blocks).select(id_col, part.alias("part_"))
    return parts.groupBy(id_col).agg(F.pow(F.sum("part_") / n, F.lit(1.0 / POWER)).alias("score"))


def floor(ranked_rows: DataFrame, least: float = FLOOR, score: str = "score") -> DataFrame:
    """After the limit, so fewer than k rows may stay; not positive: none is dropped."""
    return ranked_rows.where(F.col(score) >= least) if least > 0 else ranked_rows


def sparse_scores(terms: DataFrame, query: DataFrame, id_col: str = "id") -> DataFrame:
    """id, score from long tables (id, term, weight) and (piece, term, weight): power mean over all pieces of the dot products.

    An equi-join on the term; a piece that shares no term with a document adds 0.
    """
    n = F.broadcast(query.agg(F.countDistinct("piece").alias("n_pieces")))
    dots = terms.join(query.withColumnRenamed("weight", "query_weight"), "term").groupBy(id_col, "piece").agg(F.sum(F.col("weight") * F.col("query_weight")).alias("dot"))
    powers = dots.groupBy(id_col).agg(F.sum(F.pow(F.greatest("dot", F.lit(0.0)), F.lit(10.0))).alias("total"))
    return powers.crossJoin(n).select(id_col, F.pow(F.col("total") / F.col("n_pieces"), F.lit(0.1)).alias("score"))


def candidates_only(scored: DataFrame, candidates: DataFrame, id_col: str = "id") -> DataFrame:
    return scored.join(candidates.select(id_col).distinct(), id_col, "left_semi")


def missing(candidates: DataFrame, stored: DataFrame, id_col: str = "id") -> DataFrame:
    """Candidate ids that the store doesn't have."""
    return candidates.select(id_col).distinct().join(stored.select(id_col), id_col, "left_anti")


def require_all(candidates: DataFrame, stored: DataFrame, id_col: str = "id") -> None:
    if first := missing(candidates, stored, id_col).head():
        raise ValueError(f"the sparse store lacks candidate {first[0]}")


def rrf(a: DataFrame, b: DataFrame, weight_a: float = 1.0, weight_b: float = 1.0, k: int = RRF_K, top_k: int | None = None, id_col: str = "id") -> DataFrame:
    """Reciprocal rank fusion of (id, score, rank) lists by a full outer join; of a repeated id the last rank counts."""
    side = lambda df, x: df.groupBy(id_col).agg(F.max("rank").alias(f"rank_{x}"), F.max_by("score", "rank").alias(f"score_{x}"))
    part = lambda x, w: F.when(F.col(f"rank_{x}").isNotNull(), F.lit(w) / (F.lit(float(k)) + F.col(f"rank_{x}"))).otherwise(0.0)
    fused = side(a, "a").join(side(b, "b"), id_col, "full_outer").withColumn("rrf_score", part("a", weight_a) + part("b", weight_b))
    return top(fused, top_k if top_k and top_k > 0 else None, id_col, "rrf_score")


def rename_contract(fused: DataFrame, first: str, second: str) -> DataFrame:
    """score_a, rank_a, score_b, rank_b named after their stages, unless such columns are there already."""
    names = {f"{what}_{side}": f"{stage}_{what}" for side, stage in (("a", first), ("b", second)) for what in ("score", "rank")}
    return fused.withColumnsRenamed({old: new for old, new in names.items() if new not in fused.columns})


def passthrough(retrieval: DataFrame, k: int = 50) -> DataFrame:
    """Reranking switched off: the first k, scores copied."""
    return top(retrieval, k, score="rrf_score").withColumn("rerank_rrf_score", F.col("rrf_score"))


def rerank(retrieval: DataFrame, second_stage: Callable[[DataFrame], DataFrame], k: int = 50, decimals: int = 9) -> DataFrame:
    """The first stage's top k, the band, scored again and fused with itself.

    ``second_stage`` takes the band (id) and gives (id, piece, score) of these ids alone; scores are averaged over the pieces.
    """
    band = ranked(retrieval.select("id", F.col("rrf_score").alias("score")), k)
    second = ranked(second_stage(band.select("id")).groupBy("id").agg(F.round(F.avg("score"), decimals).alias("score")), k)
    return rename_contract(rrf(band, second, top_k=k).withColumnRenamed("rrf_score", "rerank_rrf_score"), "retrieval", "colbert")


def hydrate(ranked_rows: DataFrame, chunked: DataFrame, keys: list[str]) -> DataFrame:
    """Text and true offsets of ranked chunks; rows without a chunk go. k rows meet the chunks by an equi-join."""
    return ranked_rows.join(chunked, keys)


def hydrate_valid(ranked_rows: DataFrame, chunked: DataFrame) -> DataFrame:
    """Ranked rows (path, chunk_idx and others) with their chunk; rows of a blank path, a file that isn't there, or a number that is null or beyond the file's chunks go."""
    usable = ranked_rows.where(~blank(F.col("path")) & F.col("chunk_idx").isNotNull() & (F.col("chunk_idx") >= 0))
    return usable.join(chunked, ["path", "chunk_idx"])


def labelled_centroids(vectors: DataFrame, label: str, vector: str = "vector") -> DataFrame:
    """label, dim, mean: element-wise means; merged by each task before the shuffle."""
    return vectors.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, F.col("dim").cast("long").alias("dim")).agg(F.avg(F.col("x").cast("double")).alias("mean"))


def nearest(stored: DataFrame, query: Column, k: int, id_col: str = "id", vector: str = "vector") -> DataFrame:
    return ranked(stored.select(id_col, cosine_eps(F.col(vector), query).alias("score")), k, id_col)
