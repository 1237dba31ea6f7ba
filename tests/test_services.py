"""Answers, filters and plan checks by hand-computed values."""

import pytest
from pyspark.sql import functions as F

from scholium.functions import text
from scholium.operators import answers, services
from scholium.scope import TenantScope


def test_filters(spark):
    chunks = spark.createDataFrame([("a", 1, 7, "c", "x", 1), ("a", 2, 8, "c", "x", 2), ("b", 3, 7, "c", "x", 1)], "tenant_id string, chunk_id int, document_id int, course_id string, topic string, page int")
    docs = spark.createDataFrame([("a", 7, "book"), ("a", 8, "slide"), ("b", 7, "slide")], "tenant_id string, document_id int, source_type string")
    ids = lambda f, **k: sorted(r.chunk_id for r in services.filtered(chunks, TenantScope("a"), f, docs, **k).collect())
    slides = services.Filters(source_types=("slide",))
    assert ids(services.Filters()) == [1, 2] and ids(services.Filters(page=2)) == [2] and ids(slides) == [2] and ids(slides, enabled=False) == [1, 2]
    assert services.Filters(course_id="c", page=0).active() == ["course_id", "page"]
    with pytest.raises(ValueError):
        services.filtered(chunks, TenantScope("a"), slides)


def test_brackets_without_ids_are_prose():
    assert answers._without("a [S1, S9] b [S9] c [see 3]", {"S1"}) == "a [S1] b  c [see 3]"


def test_first_chars(spark):
    df = spark.createDataFrame([("short  text",), ("x" * 30 + ". " + "y" * 40,), ("z. " + "y" * 80,)], "t string")
    assert [r[0] for r in df.select(text.first_chars(F.col("t"), 50)).collect()] == ["short text", "x" * 30 + ".", "z. " + "y" * 47 + "..."]


def test_grounding(spark):
    rows = spark.createDataFrame([(1, None), (2, -1.0), (2, -2.0), (3, -1.0)], "turn_id int, rerank_score double")
    got = {r.turn_id: (r.grounded, r.evidence_count, r.max_rerank_score) for r in answers.grounding(rows, spark.createDataFrame([(3,), (4,)], "turn_id int")).collect()}
    assert got == {1: (True, 1, None), 2: (False, 0, -1.0), 3: (True, 0, -1.0), 4: (True, 0, None)}


def test_claims(spark):
    df = spark.createDataFrame([(1, "Trees have nodes. Cats purr loudly.", "trees and nodes have parents"), (2, "", "x")], "answer_id int, text string, context string")
    assert {r.answer_id: (r.n_statements, r.n_supported) for r in answers.supported_claims(df).collect()} == {1: (2, 1), 2: (0, 0)}


def test_outputs_without_prompt_echo(spark):
    df = spark.createDataFrame([("Fine. You are a careful tutor for the course X",)], "text string")
    r = answers.validated(df).first()
    assert (r.clean, r.valid, r.degraded) == ("Fine.", True, ["system_prompt_leak"])


def test_small_columns(spark):
    r = spark.range(1).select(
        services.raised_floor(F.lit(0.2), 0.6).alias("a"), services.raised_floor(F.lit(0.9), 0.6).alias("b"), services.minutes(F.lit(1.25)).alias("m"),
        services.provider(F.lit("openai/gpt/x")).alias("p"), services.fallback_chain(F.lit("m"), F.lit("")).alias("c")).first()
    assert (r.a, r.b, r.m, r.p, r.c) == (0.6, 0.9, 75, "openai", ["m"])
    assert sum(services.RUBRIC.values()) == pytest.approx(1)


def test_plans_for_unknown_goals(spark):
    goals = spark.createDataFrame([(1, None, "", "Logic"), (2, None, "sets", None), (3, 9, "x", None)], "plan_id int, concept_id int, goal_text string, course_name string")
    assert {r.plan_id: r.title for r in services.degraded_plan(goals, 1.0).collect()} == {1: "Logic", 2: "sets"}


def test_used_citations_and_narrowing(spark):
    said = spark.createDataFrame([(1, ["S2", "S1", "S9"])], "query_id int, cited array<string>")
    context = spark.createDataFrame([(1, "S1", 10), (1, "S2", 20)], "query_id int, citation_id string, chunk_id int")
    assert sorted((r.place, r.chunk_id) for r in answers.used_citations(said, context).collect()) == [(0, 20), (1, 10)]
    maps = spark.createDataFrame([({"a": 1.0, "b": 2.0}, ["a"]), ({"a": 1.0}, None)], "m map<string,double>, w array<string>")
    assert [r.m for r in services.narrowed(maps, "m", F.col("w")).collect()] == [{"a": 1.0}, {"a": 1.0}]
