"""Gates that depend on order, against plain folds."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scholium.operators import gates, graph
from scholium.queries import gates as queries

D = "/root/testdata/sf0.001"


def leads(edges, a, b, depth):
    """Whether a leads to b in 1 to ``depth`` steps."""
    level, seen = {a}, set()
    for _ in range(depth):
        level = {w for v in level for w in edges[v]} - seen
        if b in level:
            return True
        seen |= level
    return False


def plain_components(pairs):
    ahead = defaultdict(set)
    for a, b in pairs:
        ahead[a].add(b)
    nodes = {x for p in pairs for x in p}
    reach = {}
    for v in nodes:
        seen, todo = set(), [v]
        while todo:
            for w in ahead[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        reach[v] = seen
    groups = {frozenset({w for w in reach[v] if v in reach[w]}) for v in nodes}
    return {g for g in groups if len(g) > 1}


@pytest.mark.parametrize("seed", range(2))
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45 + 10 * seed)]
    df = spark.createDataFrame(pairs, "at long, to long")
    groups = defaultdict(set)
    for r in gates.strong_components(df).collect():
        groups[r.component].add(r.node)
    assert {frozenset(g) for g in groups.values()} == plain_components(pairs)


@pytest.mark.parametrize("local_edges", [0, 10])
def test_strong_components_by_joins(spark, local_edges):
    """More open edges than one task takes: the rounds of joins go on, to the end or until few are left."""
    rng = random.Random(3)
    pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(26)] + [(100, 101), (101, 100)]
    groups = defaultdict(set)
    for r in gates.strong_components(spark.createDataFrame(pairs, "at long, to long"), local_edges).collect():
        groups[r.component].add(r.node)
    assert {frozenset(g) for g in groups.values()} == plain_components(pairs)


@pytest.mark.parametrize("seed", range(20))
def test_components_of_few_edges(seed):
    rng = random.Random(seed)
    n = rng.choice([2, 6, 30])
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([n, 2 * n]))]
    pairs = [p for p in pairs if p[0] != p[1]]
    at, to = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
    assert {frozenset(g) for g in gates.components(at, to, n)} == plain_components(pairs)


def test_long_chain_needs_few_jobs(spark):
    """A chain of 300 concepts with a cycle at its end: rounds of peeling do not grow with its length."""
    pairs = [(i, i + 1) for i in range(300)] + [(300, 299)]
    calls, plain = [], graph.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(graph, "written", lambda df, name: calls.append(name) or plain(df, name))
        got = gates.strong_components(spark.createDataFrame(pairs, "at long, to long")).collect()
    assert {(r.node, r.component) for r in got} == {(299, 300), (300, 300)} and len(calls) < 5


def test_no_cycle_no_component(spark):
    assert gates.strong_components(spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "at long, to long")).count() == 0
    assert gates.strong_components(spark.createDataFrame([], "at long, to long")).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_closing_is_a_fold(seed):
    rng = random.Random(seed)
    n, depth = rng.choice([5, 12, 30]), rng.choice([2, 4, 20])
    known = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([0, n // 2, n]))]
    proposed = [(rng.randrange(n), rng.randrange(n), rng.random() < 0.8) for _ in range(4 * n)]
    edges, want = defaultdict(set), []
    for a, b in known:
        edges[a].add(b)
    for a, b, enters in proposed:
        want.append(a == b or leads(edges, b, a, depth))
        if enters and not want[-1]:
            edges[a].add(b)
    assert gates.closing(known, proposed, depth) == want


def test_cycle_gate(spark):
    rng = random.Random(5)
    keys = {(rng.randrange(30), rng.randrange(30), rng.choice(["requires", "part_of", "related_to"])) for _ in range(220)}
    proposed = [(*k, rng.random() < 0.9, i) for i, k in enumerate(sorted(keys, key=lambda _: rng.random()))]
    known = [(rng.randrange(30), rng.randrange(30), rng.choice(["requires", "part_of"])) for _ in range(25)]
    edges, want = defaultdict(lambda: defaultdict(set)), {}
    for a, b, r in known:
        edges[r][a].add(b)
    for a, b, r, enters, _ in proposed:
        want[a, b, r] = r != "related_to" and (a == b or leads(edges[r], b, a, 20))
        if enters and not want[a, b, r]:
            edges[r][a].add(b)
    p = spark.createDataFrame(proposed, "source_id long, target_id long, relation string, enters boolean, place long")
    got = gates.cycle_gate(p, spark.createDataFrame(known, "source_id long, target_id long, relation string"), ("place",))
    assert {(r.source_id, r.target_id, r.relation): r.cycle for r in got.collect()} == want


def plain_batch(rows, known, per_chunk, per_document, floor=0.5):
    """The fold as it is specified, row by row: gate counts and each edge's gate."""
    counts, evidence, order = Counter(), {}, lambda r: (r.document_id, r.chunk_id, r.seq)
    flat = lambda x: re.sub(r"\s+", " ", x).strip().lower()
    slug = lambda x: re.sub("[^a-z0-9]+", "-", x.lower()).strip("-")
    in_chunk = Counter()
    for r in sorted(rows, key=order):
        in_chunk[r.chunk_id] += 1
        gate = None
        if in_chunk[r.chunk_id] > per_chunk:
            gate = "chunk_edge_cap"
        elif r.relation not in ("requires", "contains", "related_to", "part_of", "assesses", "taught_by"):
            gate = "relation_enum"
        elif slug(r.source_name) == slug(r.target_name):
            gate = "self_relation"
        elif r.relation == "requires" and r.cue == "inferred":
            gate = "inferred_requires"
        elif len(r.quote) < 10 or re.match(r"(?:[#\-*•|>]|\d+[.)]\s)", r.quote):
            gate = "quote_boilerplate"
        elif flat(r.quote) not in flat(r.chunk_text):
            gate = "verbatim_provenance"
        if gate:
            counts[gate] += 1
            continue
        key = r.source_id, r.target_id, r.relation
        if key in evidence:
            counts["duplicate_edge"] += 1
        evidence.setdefault(key, []).append(r)
    waits = defaultdict(set)
    for a, b, rel in evidence:
        if rel == "requires":
            waits[a].add(b)
            waits[b] |= set()
    while free := [v for v, w in waits.items() if not w]:
        for v in free:
            del waits[v]
        for w in waits.values():
            w.difference_update(free)
    graph, links, verified = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), set()
    for r in known:
        graph[r.relation][r.source_id].add(r.target_id)
        links[r.relation][r.source_id].add(r.target_id)
        if r.verified:
            verified.add((r.source_id, r.target_id, r.relation))
    written, gates_of = Counter(), {}
    for key, found in evidence.items():
        a, b, rel = key
        docs, chunks = len({r.document_id for r in found}), len({r.chunk_id for r in found})
        cue = 1.0 if any(r.cue == "explicit" for r in found) else 0.4 if chunks > 1 else 0.0
        agree = 1.0 if key in verified else 0.0 if (b, a, rel) in verified else 0.7 if leads(links[rel], a, b, 3) else 0.0
        score = round(0.15 + 0.25 * min(max(r.model_confidence for r in found), 0.8) + 0.3 * (1 - math.exp(-docs / 2)) + 0.2 * cue + 0.1 * agree, 6)
        document, gate = found[0].document_id, None
        if rel == "requires" and a in waits and b in waits:
            gate = "contradictory_cycle"
        elif written[document] >= per_document:
            gate = "document_edge_cap"
        elif rel in ("requires", "part_of") and leads(graph[rel], b, a, 20):
            gate = "cycle"
        elif key in verified:
            gate = "verified_conflict"
        elif score < floor:
            gate = "confidence_floor"
        else:
            written[document] += 1
            graph[rel][a].add(b)
        gates_of[key] = (score, gate)
        counts[gate] += gate is not None
    return gates_of, +counts


@pytest.mark.parametrize("per_chunk, per_document", [(6, 20), (20, 5)])
def test_batch_in_order(spark, per_chunk, per_document):
    proposals, known = queries.proposals(spark, D), queries.known_edges(spark, D)
    want, counts = plain_batch(proposals.collect(), known.collect(), per_chunk, per_document)
    batch = gates.admitted(proposals, known, per_chunk, per_document)
    got = {(r.source_id, r.target_id, r.relation): (r.confidence, r.gate) for r in batch.edges.collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-5 for k in want)
    assert {r.gate: r.n for r in batch.counts().collect()} == dict(counts)
    fired = {"relation_enum", "self_relation", "inferred_requires", "quote_boilerplate", "verbatim_provenance", "duplicate_edge", "contradictory_cycle", "cycle", "verified_conflict", "confidence_floor"}
    assert fired | {"chunk_edge_cap" if per_chunk < 8 else "document_edge_cap"} <= counts.keys()


def test_rows_of_other_documents_and_without_chunk(spark):
    columns = "source_id long, target_id long, source_name string, target_name string, relation string, cue string, model_confidence double, document_id long, chunk_id long, seq long, quote string, chunk_text string, tenant_id string, chunk_tenant_id string, chunk_document_id long"
    row = lambda i, chunk, tenant, document: (i, i + 1, f"Concept {i}", f"Concept {i + 1}", "requires", "explicit", 0.9, 1, chunk, i, "a quote of some length", "a quote of some length", "t", tenant, document)
    rows = spark.createDataFrame([row(1, 1, "t", 1), row(2, 1, "u", 1), row(3, 1, "t", 2), row(4, 1, "t", 1), row(5, None, "t", 1), row(6, None, "t", 1), row(7, None, "t", 1)], columns)
    batch = gates.admitted(rows, spark.createDataFrame([], "source_id long, target_id long, relation string, verified boolean"), per_chunk=2)
    assert {r.seq: r.gate for r in batch.rows.collect()} == {1: None, 2: "document_scope", 3: "document_scope", 4: "chunk_edge_cap", 5: "missing_provenance", 6: "missing_provenance", 7: "missing_provenance"}


def test_aliases_belong_to_the_first(spark):
    rows = spark.createDataFrame([("t", None, 1, "Linear Algebra", 1), ("t", None, 2, "linear-algebra", 2), ("t", "c", 2, "Linear algebra!", 3), ("u", None, 3, "LINEAR ALGEBRA", 4), ("t", None, 1, "linear algebra", 5), ("t", None, 4, "known", 6), ("t", None, 5, "Known", 7), ("t", None, 6, "?!", 8), ("t", None, 6, None, 9)], "tenant_id string, course_id string, concept_id long, alias string, seq long")
    stored = spark.createDataFrame([("t", None, "known", 5)], "tenant_id string, course_id string, alias_norm string, concept_id long")
    got = {r.seq: (r.gate, r.new) for r in gates.assigned_aliases(rows, stored).collect()}
    assert got == {1: (None, True), 2: ("alias_collision", False), 3: (None, True), 4: (None, True), 5: (None, False), 6: ("alias_collision", False), 7: (None, False), 8: ("empty_name", False), 9: ("empty_name", False)}
    table = gates.alias_table(rows, stored)
    assert table.count() == 4 and {r.seq: r.new for r in gates.assigned_aliases(rows, table).collect()} == dict.fromkeys(range(1, 10), False)
