"""Catalogue search against a plain scan, and other repairs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scholium.operators import catalogue as C, learning
from scholium.sources import files

COLUMNS = "resource_id long, title string, description string, provider string, url string, kind string"
ROWS = [
    (1, "Linear Algebra", "matrices and vectors", "MIT", "u3", "book"), (2, "Algebra 100%", None, "Open_Press", "u1", "book"), (3, "Über Algebren", "aab", "x", "u2", "video"), (4, None, "100 percent", None, "u0", None),
    (5, "ab", "a", "", "u5", "video"), (6, "Linear Algebra", "again", "mit", "u2b", "video"), (7, "back\\slash", "%", "_", "u7", "book"),
]
ASKED = ["algebra", "ALGEBRA ", "100%", "_", "a", "ab", "\\", "zzz", "über", "", None, "  ", "linear algebra and more", "mit", "lgebr", "a b"]


def plain(query, kind, limit, offset):
    pattern = (query or "").strip().lower()
    found = [r for r in ROWS if (not pattern or any(pattern in (r[c] or "").lower() for c in (1, 2, 3))) and (kind is None or r[5] == kind)]
    found.sort(key=lambda r: (r[1] is not None, r[1] or "", r[4]))
    return [(r[0], i + 1, len(found)) for i, r in enumerate(found)][offset : offset + limit]


@pytest.mark.parametrize("limit, offset", [(20, 0), (2, 1)])
def test_search(spark, limit, offset):
    catalogue = C.indexed(spark.createDataFrame(ROWS, COLUMNS))
    asked = [(i, q, kind) for i, (q, kind) in enumerate((q, k) for q in ASKED for k in (None, "video"))]
    got = {}
    for r in catalogue.search(spark.createDataFrame(asked, "query_id long, query string, kind string"), limit, offset).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.resource_id, r.place, r.total))
    assert got == {i: p for i, q, kind in asked if (p := plain(q, kind, limit, offset))}


def test_only_rows_that_share_the_gram_are_read(spark):
    catalogue = C.indexed(spark.createDataFrame(ROWS, COLUMNS))
    asked = spark.createDataFrame([(1, "linear alg"), (2, "zzz")], "query_id long, pattern string")
    assert {(r.query_id, r.resource_id) for r in catalogue.candidates(asked).collect()} == {(1, 1), (1, 6)}
    plan = catalogue.search(asked.withColumnRenamed("pattern", "query"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_like_pattern(spark):
    rows = spark.createDataFrame([("50%_\\",)], "q string")
    assert rows.select(C.like_pattern(rows.q).alias("p")).first().p == "%50\\%\\_\\\\%"


def test_covering_looks_at_so_many_rows(spark):
    gaps = spark.createDataFrame([(1, "a"), (1, "b"), (1, ""), (2, "c")], "user_id long, slug string")
    covers = spark.createDataFrame([(10, "a"), (10, "b"), (11, "a"), (12, "b")], "resource_id long, slug string")
    resources = spark.createDataFrame([(10, "m"), (11, "k"), (12, "z")], "resource_id long, url string")
    got = {(r.user_id, r.resource_id): r.slugs for r in C.covering(gaps, covers, resources, 2).collect()}
    assert got == {(1, 11): ["a"], (1, 10): ["a"]}
    assert C.covering(gaps, covers, resources).count() == 3


def test_corpus_hash_tells_null_from_empty(spark):
    of = lambda *rows: files.ranged_corpus_hash(spark.createDataFrame(rows, "filename string, text string"), 1).first()[0]
    kinds = [of(("a", "x")), of(("a", "x"), ("b", None)), of(("a", "x"), ("b", "")), of(("a", "x"), (None, "")), of(("a", "x"), ("", ""))]
    assert len(set(kinds)) == 5 and of(("b", None), ("a", "x")) == kinds[1]


def test_corpus_hash_in_pieces(spark):
    """One hash, whatever the pieces are: no task reads more than one of them."""
    texts = [(f"{i:03}", None if i % 17 == 3 else f"text ü {i}" * (i % 9)) for i in range(200)]
    want = hashlib.sha256("".join(f"{a}\0{b or ''}\0" for a, b in sorted(texts, key=lambda x: x[0])).encode()).hexdigest()
    docs = spark.createDataFrame([*reversed(texts), (None, "left out")], "filename string, text string").repartition(3)
    assert [files.corpus_hash(docs, n).first()[0] for n in (1 << 20, 5000, 300)] == [want] * 3
    one = docs.where("filename = '005' or filename is null").unionByName(docs.where("filename = '005'"))  # more pieces than names
    assert files.corpus_hash(one, 10).first()[0] == hashlib.sha256(f"005\0{texts[5][1]}\0".encode() * 2).hexdigest()
    assert files.corpus_hash(docs.where("false")).collect()[0][0] is None


def test_corpus_hash_hands_its_state_on(spark):
    docs = spark.range(3000).selectExpr("cast(id as string) filename", "repeat('x', 1000) text")
    got = files.corpus_hash(docs, 500_000)
    sizes = [r[0] for r in spark.read.parquet(*got.inputFiles()).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 1500 and got.first()[0] == hashlib.sha256("".join(f"{k}\0{'x' * 1000}\0" for k in sorted(map(str, range(3000)))).encode()).hexdigest()


def test_mastery_reads_a_written_reference(spark):
    rows = spark.sql("select 1L user_id, 2L concept_id, 0.5D value, 1.0D weight, timestamp'2024-01-01' at, 0L seq")
    assert "latest-observations" in learning.mastery(rows)._jdf.queryExecution().executedPlan().toString()
