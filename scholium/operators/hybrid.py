"""Both retrievers together, where either may have nothing to say, and why it has not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from scholium.operators import lexical as L, ranking as R
from scholium.operators.index import Index
from scholium.operators.vector import cosine_top_k
from scholium.store import small, written

# Why a side has no list.
SEMANTIC_UNAVAILABLE, LEXICAL_UNAVAILABLE = "semantic_unavailable", "lexical_unavailable"


@dataclass
class Side:
    """A retriever's rank list (query_id, chunk_id, score, rank) and the reasons (query_id, reason) of questions that it could not answer."""

    ranked: DataFrame
    reasons: DataFrame


def _kind(rows: DataFrame) -> DataFrame:
    """Adds kind: tenant, model and dimension. Vectors of unlike kinds are never compared."""
    known = F.col("embedding").isNotNull() & F.col("tenant_id").isNotNull() & F.col("model").isNotNull()
    return rows.withColumn("kind", F.when(known, F.to_json(F.struct("tenant_id", "model", F.size("embedding").alias("dim")))))


def semantic_side(questions: DataFrame, vectors: DataFrame, k: int = 20) -> Side:
    """``questions`` (query_id, tenant_id, model, embedding: null where it failed) against ``vectors`` (tenant_id, chunk_id, model, embedding).

    Only vectors of the question's tenant, model and dimension are compared; a
    question without a vector, or without any to compare with, is unavailable.
    """
    asked, there = _kind(questions), _kind(vectors)
    own = lambda rows, c: rows.where("kind is not null").select(F.col(c), F.col("kind").alias("tenant_id"), "embedding")
    ranked = cosine_top_k(own(asked, "query_id"), own(there, "chunk_id").withColumnRenamed("chunk_id", "vec_id"), k, by_tenant=True)
    kinds = written(there.where("kind is not null").select("kind").distinct(), "vector-kinds")
    lost = asked.select("query_id", "kind").join(small(kinds), "kind", "left_anti")
    return Side(ranked.withColumnRenamed("vec_id", "chunk_id"), lost.select("query_id", F.lit(SEMANTIC_UNAVAILABLE).alias("reason")))


def lexical_side(questions: DataFrame, index: Index | None, k: int = 20) -> Side:
    """BM25 of ``questions`` (query_id, tenant_id, text) out of ``index``; without an index, or one that nothing was put into, it is unavailable."""
    if index is None or not index.generations():
        none = questions.sparkSession.createDataFrame([], "query_id long, tenant_id string, chunk_id long, score double, rank int")
        return Side(none, questions.select("query_id", F.lit(LEXICAL_UNAVAILABLE).alias("reason")))
    stats = index.table("lengths").groupBy("tenant_id").agg(F.sum("n_chunks").alias("doc_count")).where("doc_count > 0")
    why = L.degradations(questions, stats)
    # a question without terms is not looked up, so nothing is known of its tenant
    return Side(index.bm25(questions, k), why.where("size(degraded) > 0").select("query_id", F.get("degraded", F.lit(0)).alias("reason")))


@dataclass
class Outcome:
    """What is found, and for every question its reasons, the lengths of both lists and the mode that this comes to."""

    ranked: DataFrame
    states: DataFrame


def hybrid(questions: DataFrame, semantic: Side, lexical: Side, chunks: DataFrame, top_n: int = 20, k: int = 5, **options) -> Outcome:
    """Fuses, reranks and cuts what there is: a side without a list leaves the other's."""
    a, b = written(semantic.ranked, "semantic"), written(lexical.ranked, "lexical")
    ranked = R.rank_pipeline(questions, a, b, chunks, top_n, k, **options)
    reasons = semantic.reasons.unionByName(lexical.reasons).groupBy("query_id").agg(F.sort_array(F.collect_set("reason")).alias("degraded"))
    size = lambda rows, name: rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    sizes = questions.select("query_id").join(size(a, "n_semantic"), "query_id", "left").join(size(b, "n_lexical"), "query_id", "left").join(size(ranked, "n_reranked"), "query_id", "left").fillna(0)
    states = R.retrieval_mode(sizes).join(reasons, "query_id", "left").withColumn("degraded", F.coalesce("degraded", F.array().cast("array<string>")))
    return Outcome(ranked, states)
