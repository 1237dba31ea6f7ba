"""Fusion and reranking of rank lists, for batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from scholium.functions.text import index_terms, tokenize
from scholium.operators.lexical import top_k

RRF_K = 60
FLOOR = -8.0


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, score, best_rank over lists (query_id, retriever, chunk_id, rank).

    An id twice in one list keeps its best rank there; its other places stay taken.
    """
    best = lists.groupBy("query_id", "retriever", "chunk_id").agg(F.min("rank").alias("rank"))
    return best.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))


def fuse(semantic: DataFrame, lexical: DataFrame, k: int = RRF_K, top_n: int = 20) -> DataFrame:
    """query_id, chunk_id, semantic_rank, lexical_rank, source, rrf_score, final_rank.

    Ordered by score, then best rank, then id. The row comes from the list that
    ranks it better, the semantic one if they agree.
    """
    lists = semantic.select("query_id", "chunk_id", F.lit("semantic").alias("retriever"), "rank").unionByName(lexical.select("query_id", "chunk_id", F.lit("lexical").alias("retriever"), "rank"))
    best = lists.groupBy("query_id", "chunk_id").agg(
        F.min(F.when(F.col("retriever") == "semantic", F.col("rank"))).alias("semantic_rank"), F.min(F.when(F.col("retriever") == "lexical", F.col("rank"))).alias("lexical_rank"))
    score = sum((F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0)) for c in ("semantic_rank", "lexical_rank")), F.lit(0.0))
    source = F.when(F.col("lexical_rank").isNull() | (F.col("semantic_rank") <= F.col("lexical_rank")), "semantic").otherwise("lexical")
    scored = best.select("*", source.alias("source"), F.round(score, 9).alias("rrf_score"))
    order = [F.desc("rrf_score"), F.least("semantic_rank", "lexical_rank").asc(), F.asc("chunk_id")]
    return top_k(scored, ["query_id"], order, top_n, "final_rank")


def lexical_rerank(questions: DataFrame, candidates: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """query_id, chunk_id, rerank_score, rerank_rank: term overlap over the root of a chunk's length.

    Only candidates are scored; a candidate named twice counts once. Tokens hold stop words.
    """
    asked = questions.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("asked"))
    given = candidates.select("query_id", "chunk_id").distinct()
    joined = given.join(chunks.select("chunk_id", "tokens"), "chunk_id").join(asked, "query_id")
    # few bytes but much to compare: without a number of its own the shuffle would end in one task
    joined = joined.repartition(questions.sparkSession.sparkContext.defaultParallelism, "query_id", "chunk_id")
    hits = F.size(F.filter("tokens", lambda t: F.array_contains("asked", t)))
    score = F.when(F.size("tokens") > 0, hits / F.sqrt(F.size("tokens"))).otherwise(0.0)
    scored = joined.select("query_id", "chunk_id", F.round(score, 6).alias("rerank_score"))
    return top_k(scored, ["query_id"], [F.desc("rerank_score"), F.asc("chunk_id")], k, "rerank_rank")


def floored(ranked: DataFrame, floor: float = FLOOR, score: str = "rerank_score", rank: str = "rerank_rank") -> DataFrame:
    """Rows at the floor or above; where that leaves a question none, its first row and the reason."""
    best = F.max(score).over(Window.partitionBy("query_id"))
    marked = ranked.withColumn("_best", best)
    kept = marked.where((F.col(score) >= floor) | ((F.col("_best") < floor) & (F.col(rank) == 1)))
    return kept.withColumn("degraded", F.when(F.col("_best") < floor, F.lit("rerank_floor_removed_all"))).drop("_best")


def reordered(candidates: DataFrame, reranked: DataFrame) -> DataFrame:
    """query_id, chunk_id, rerank_score, place: what a reranker returned (query_id, seq, chunk_id, rerank_score), in its order.

    Ids that it was not given are left out, and of an id returned twice the first
    counts, so that no reranker adds or doubles a passage.
    """
    key = ["query_id", "chunk_id"]
    known = reranked.join(candidates.select(*key).distinct(), key, "left_semi")
    first = known.groupBy(*key).agg(F.min("seq").alias("seq"), F.min_by("rerank_score", "seq").alias("rerank_score"))
    return first.select(*key, "rerank_score", F.row_number().over(Window.partitionBy("query_id").orderBy("seq")).alias("place"))


def rank_pipeline(questions: DataFrame, semantic: DataFrame, lexical: DataFrame, chunks: DataFrame, top_n: int = 20, k: int = 5, floor: float = FLOOR, reranker=lexical_rerank) -> DataFrame:
    """Fuse, rerank, floor, cut. A question that the reranker gives nothing keeps its fused order and says so."""
    fused = fuse(semantic, lexical, top_n=top_n)
    reranked = floored(reranker(questions, fused, chunks, top_n), floor)
    out = fused.join(reranked.select("query_id", "chunk_id", "rerank_score", "rerank_rank", "degraded"), ["query_id", "chunk_id"], "left")
    answered = F.max(F.col("rerank_rank")).over(Window.partitionBy("query_id"))
    out = out.withColumn("_answered", answered.isNotNull()).where(F.col("rerank_rank").isNotNull() | ~F.col("_answered"))
    out = out.withColumn("degraded", F.when(~F.col("_answered"), F.lit("reranker_unavailable")).otherwise(F.col("degraded")))
    order = [F.when(F.col("_answered"), F.col("rerank_rank")).otherwise(F.col("final_rank")).asc()]
    return top_k(out, ["query_id"], order, k, "place").drop("_answered")


def multi_query(results: DataFrame) -> DataFrame:
    """turn_id, chunk_id, query_no, rank, position: first query that found a chunk wins, order kept."""
    first = Window.partitionBy("turn_id", "chunk_id").orderBy("query_no", "rank")
    once = results.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("position", F.row_number().over(Window.partitionBy("turn_id").orderBy("query_no", "rank")))


def last_copy_first_place(evidence: DataFrame) -> DataFrame:
    """Evidence appended twice: the last copy's values at the first copy's place."""
    values = [c for c in evidence.columns if c not in ("turn_id", "chunk_id", "seq")]
    best = evidence.groupBy("turn_id", "chunk_id").agg(F.max_by(F.struct(*values), "seq").alias("v"), F.min("seq").alias("seq"))
    return best.select("turn_id", "chunk_id", "seq", "v.*")


def evidence_order(evidence: DataFrame) -> DataFrame:
    """Rerank score descending with nulls last, then RRF score, then arrival."""
    order = Window.partitionBy("turn_id").orderBy(F.desc_nulls_last("rerank_score"), F.desc("rrf_score"), F.asc("seq"))
    return evidence.withColumn("place", F.row_number().over(order))


def retrieval_mode(sizes: DataFrame) -> DataFrame:
    """Adds mode to (query_id, n_semantic, n_lexical, n_reranked)."""
    s, x = F.col("n_semantic") > 0, F.col("n_lexical") > 0
    return sizes.withColumn("mode", F.when(~s & ~x, "retrieval_empty").when(~s, "lexical_only").when(~x, "semantic_only").when(F.col("n_reranked") == 0, "reranker_unavailable"))
