"""Either side of a search may be absent; the other goes on, and the reasons are told."""

import math

from scholium.operators import hybrid as H, index as I, lexical as L

CHUNKS = [("t", 1, 1, "alpha beta gamma"), ("t", 1, 2, "alpha alpha delta"), ("t", 2, 3, "gamma delta epsilon"), ("u", 3, 4, "alpha zeta")]
VECTORS = [("t", 1, "m", [1.0, 0.0]), ("t", 2, "m", [0.6, 0.8]), ("t", 3, "m", [1.0, 0.0, 0.0]), ("t", 3, "other", [0.0, 1.0]), ("u", 4, "m", [0.0, 1.0]), ("t", 9, "m", None)]
ASKED = [
    (1, "t", "alpha", "m", [1.0, 0.0]),  # both sides
    (2, "t", "gamma", "m", None),  # the question has no vector
    (3, "t", "gamma", "none", [1.0, 0.0]),  # no vector of the model
    (4, "t", "the and", "m", [0.0, 1.0]),  # no terms
    (5, "nobody", "alpha", "m", [1.0, 0.0]),  # no corpus
    (6, "t", "gamma", "m", [1.0, 0.0, 0.0]),  # another dimension
    (7, "t", "unheard", "other", [1.0, 1.0]),  # terms that match nothing are no failure
]


def tables(spark, path):
    chunks = L.analysed(spark.createDataFrame(CHUNKS, "tenant_id string, document_id long, chunk_id long, text string")).cache()
    index = I.Index(spark, f"file://{path}/index", buckets=2)
    asked = spark.createDataFrame(ASKED, "query_id long, tenant_id string, text string, model string, embedding array<double>").cache()
    return chunks, index, asked, spark.createDataFrame(VECTORS, "tenant_id string, chunk_id long, model string, embedding array<double>")


def plain_semantic(asked):
    _, tenant, _, model, q = asked
    found = []
    for t, c, m, v in VECTORS:
        if q and v and t == tenant and m == model and len(v) == len(q):
            found.append((-round(sum(x * y for x, y in zip(q, v, strict=True)) / math.sqrt(sum(x * x for x in q)) / math.sqrt(sum(x * x for x in v)), 6), c))
    return [c for _, c in sorted(found)]


def test_reasons_and_lists(spark, tmp_path):
    chunks, index, asked, vectors = tables(spark, tmp_path)
    semantic = H.semantic_side(asked, vectors)
    got = {}
    for r in semantic.ranked.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {a[0]: found for a in ASKED if (found := plain_semantic(a))} and got[6] == [3]
    assert {r.query_id for r in semantic.reasons.collect()} == {2, 3, 5}
    index.put(chunks)
    outcome = H.hybrid(asked, semantic, H.lexical_side(asked, index), chunks)
    states = {r.query_id: (r.degraded, r["mode"]) for r in outcome.states.collect()}
    assert states == {
        1: ([], None), 2: (["semantic_unavailable"], "lexical_only"), 3: (["semantic_unavailable"], "lexical_only"), 4: (["empty_query_terms"], "semantic_only"),
        5: (["no_corpus_stats", "semantic_unavailable"], "retrieval_empty"), 6: ([], None), 7: ([], "semantic_only")}
    found = {}
    for r in outcome.ranked.orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append((r.chunk_id, r.semantic_rank is not None, r.lexical_rank is not None))
    assert set(found) == {1, 2, 3, 4, 6, 7} and {c for c, _, _ in found[2]} == {1, 3} and all(not s and x for _, s, x in found[2]) and all(s and not x for _, s, x in found[4])


def test_without_an_index_the_other_side_goes_on(spark, tmp_path):
    chunks, index, asked, vectors = tables(spark, tmp_path)
    for side in (H.lexical_side(asked, None), H.lexical_side(asked, index)):
        outcome = H.hybrid(asked, H.semantic_side(asked, vectors), side, chunks)
        states = {r.query_id: (r.degraded, r["mode"]) for r in outcome.states.collect()}
        assert all("lexical_unavailable" in d for d, _ in states.values()) and states[1][1] == "semantic_only" and states[2] == (["lexical_unavailable", "semantic_unavailable"], "retrieval_empty")
        assert {r.query_id for r in outcome.ranked.collect()} == {1, 4, 6, 7}
