"""Rendering, rerankers that err, prices by source and lookups, by hand-computed values."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from scholium.functions import text
from scholium.operators import evaluation, graph, learning, ranking


def test_rendering(spark):
    rows = spark.createDataFrame([("Hi {name}, {{kept}} {name}{x}", {"name": "{x} $1", "x": ""}), ("", {}), ("no names", None), (None, {})], "t string, v map<string,string>")
    assert [r[0] for r in rows.select(text.rendered(F.col("t"), F.col("v"))).collect()] == ["Hi {x} $1, {kept} {x} $1", "", "no names", None]
    with pytest.raises(Exception, match="no value for"):
        rows.limit(1).select(text.rendered(F.lit("{gone}"), F.col("v"))).collect()


def test_a_reranker_adds_and_doubles_nothing(spark):
    given = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 10)], "query_id int, chunk_id int")
    said = spark.createDataFrame([(1, 0, 99, 9.0), (1, 1, 11, 5.0), (1, 2, 11, 8.0), (1, 3, 10, 7.0), (3, 0, 10, 1.0)], "query_id int, seq int, chunk_id int, rerank_score double")
    assert sorted(tuple(r) for r in ranking.reordered(given, said).collect()) == [(1, 10, 7.0, 2), (1, 11, 5.0, 1)]
    assert ranking.reordered(given.limit(0), said).isEmpty()


def test_prices_by_source(spark):
    calls = spark.createDataFrame([(1, "own/x", 1_000_000, 0), (2, "gpt-4o", 1_000_000, -5), (3, "odd", 10, 10), (4, "own/x", None, 0), (5, None, 1, 1), (6, "own/gpt-4o", 1_000_000, 0)], "k int, model string, prompt_tokens long, completion_tokens long")
    listed = spark.createDataFrame([(0, "gpt-4o", 2.5, 10.0)], "ord int, part string, prompt_price double, completion_price double")
    own = spark.createDataFrame([("own/x", 4.0, 1.0), ("own/gpt-4o", float("inf"), 1.0), ("odd", 0.0, 0.0)], "model string, prompt_price double, completion_price double")
    got = {r.k: (r.cost_usd, r.priced, r.source) for r in evaluation.cost_sources(calls, listed, own).collect()}
    assert got == {1: (4.0, True, "provider"), 2: (2.5, True, "static"), 3: (0.0, False, "unknown"), 4: (0.0, False, "unknown"), 5: (0.0, False, "unknown"), 6: (2.5, True, "static")}


def test_titles_and_one_hop(spark):
    concepts = spark.createDataFrame([(i, i, f"c{i}") for i in range(5)], "concept_id int, difficulty int, slug string")
    rows = [(0, 1, "requires", 0.9, 0.5, False, 7), (0, 2, "requires", 0.5, 0.9, True, 7), (0, 3, "requires", 0.9, 0.5, True, None), (0, 4, "used_in", 0.9, 0.1, False, 8), (1, 4, "used_in", 0.4, 0.1, False, 8)]
    edges = spark.createDataFrame(rows, "source_id int, target_id int, relation string, confidence double, weight double, verified boolean, document_id int")
    seeds, docs = concepts.select(F.col("concept_id").alias("seed")), spark.createDataFrame([(7, "Seven")], "document_id int, title string")
    found = graph.direct(seeds, edges, concepts, min_confidence=0.6, documents=docs).collect()
    assert sorted((r.rank, r.target_id, r.title) for r in found) == [(1, 3, None), (2, 1, "Seven")]
    assert [(r.seed, r.concept_id, r.depth, r.direction) for r in graph.search(seeds, edges, concepts, relation="used_in").collect()] == [(0, 4, 1, "used_in")]


def test_metrics_where_lists_are_empty(spark):
    lists = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id int, chunk_id int, rank int")
    qrels = spark.createDataFrame([(1, 6), (1, 7), (2, 5), (1, 6)], "query_id int, chunk_id int")
    got = {r.query_id: r for r in evaluation.question_metrics(lists, lists.limit(0), lists, lists, qrels).collect()}
    assert got.keys() == {1, 2} and (got[1].semantic_recall_at_20, got[1].lexical_recall_at_20, got[1].fused_mrr, got[1].precision_at_5, got[1].context_recall) == (0.5, 0.0, 0.5, 0.5, 0.5)
    assert all(v == 0 for k, v in got[2].asDict().items() if k != "query_id")


def test_catalogue_order_without_gaps(spark):
    res = spark.createDataFrame([(1, "b", "u1", "community"), (2, "a", "u2", "official"), (3, "a", "u0", "official"), (4, "z", "u9", None)], "resource_id int, title string, url string, trust string")
    users = spark.createDataFrame([(1,), (2,), (2,)], "user_id int")
    assert sorted((r.user_id, r.rank, r.resource_id) for r in learning.unpersonalised(res, users, 3).collect()) == [(u, p, i) for u in (1, 2) for p, i in ((1, 3), (2, 2), (3, 1))]
    assert learning.unpersonalised(res.limit(0), users).isEmpty()


def test_document_versions(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r.version for r in __spark_entry__.queries()["document_versions"](spark, d).collect()}
    text_of = lambda r: json.dumps(r.asDict(), sort_keys=True, separators=(",", ":"))
    assert got == {r.doc_id: hashlib.sha256(text_of(r).encode()).hexdigest()[:12] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
