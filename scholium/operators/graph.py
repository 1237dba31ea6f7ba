"""Bounded recursive queries over a concept graph.

``source REQUIRES target``: prerequisites lie along source -> target. Every
recursion is unrolled to its depth cap as joins and guards its path, so it ends
on any graph. Seeds are a table, so many goals are answered by one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from scholium.operators.lexical import top_k
from scholium.store import written

MIN_CONFIDENCE, MAX_DEPTH, MAX_PATH = 0.6, 3, 20
TRANSITIVE = ("requires", "part_of")


def _steps(edges: DataFrame, relation, min_confidence: float | None, reverse: bool = False) -> DataFrame:
    rows = edges.where(F.col("relation").isin([relation] if isinstance(relation, str) else list(relation)))
    if min_confidence is not None:
        rows = rows.where(F.col("confidence").cast("double") >= min_confidence)
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    return rows.select(F.col(a).alias("at"), F.col(b).alias("to"), F.col("weight").cast("double").alias("step_weight"))


def walks(seeds: DataFrame, steps: DataFrame, max_depth: int) -> DataFrame:
    """seed, concept_id, depth, weight, path: every walk that visits no concept twice."""
    level = seeds.select("seed", F.col("seed").alias("concept_id"), F.lit(0).alias("depth"), F.lit(None).cast("double").alias("weight"), F.array("seed").alias("path"))
    out = None
    for depth in range(1, max_depth + 1):
        level = level.join(steps, F.col("concept_id") == F.col("at")).where(~F.array_contains("path", F.col("to"))).select(
            "seed", F.col("to").alias("concept_id"), F.lit(depth).alias("depth"), F.col("step_weight").alias("weight"), F.concat("path", F.array("to")).alias("path"))
        out = level if out is None else out.unionByName(level)
    return out


def closure(seeds: DataFrame, edges: DataFrame, concepts: DataFrame, max_depth: int = MAX_DEPTH, min_confidence: float = MIN_CONFIDENCE, relation: str = "requires", reverse: bool = False) -> DataFrame:
    """seed, concept_id, depth, weight, path, difficulty, slug, rank of what each seed needs (or, reversed, of what needs it).

    A concept counts at its least depth, then largest weight, then least path.
    """
    found = walks(seeds, _steps(edges, relation, min_confidence, reverse), max_depth)
    first = Window.partitionBy("seed", "concept_id").orderBy("depth", F.desc("weight"), "path")
    once = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    named = once.join(concepts.select("concept_id", "difficulty", "slug"), "concept_id")
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "difficulty", F.desc("weight"), "slug")))


def direct(seeds: DataFrame, edges: DataFrame, concepts: DataFrame, relation: str = "requires", k: int = 50, min_confidence: float | None = None, documents: DataFrame | None = None) -> DataFrame:
    """One-hop neighbours with their evidence: verified first, heavier, easier, then slug.

    With ``documents`` (document_id, title) the rows that are left get the title of
    the document that their edge names, null where it names none or an unknown one.
    """
    rows = edges.where(F.col("relation") == relation).join(seeds.withColumnRenamed("seed", "source_id"), "source_id")
    if min_confidence is not None:
        rows = rows.where(F.col("confidence").cast("double") >= min_confidence)
    named = rows.join(concepts.select(F.col("concept_id").alias("target_id"), "difficulty", "slug"), "target_id")
    best = top_k(named, ["source_id"], [F.desc("verified"), F.desc("weight"), F.asc("difficulty"), F.asc("slug")], k)
    return best if documents is None else best.join(documents.select("document_id", "title"), "document_id", "left")


def related(seeds: DataFrame, edges: DataFrame, concepts: DataFrame, k: int = 12, min_confidence: float | None = None) -> DataFrame:
    """seed, concept_id, kind, difficulty, slug, rank: related concepts and siblings under one parent.

    Each kind is cut to k by (difficulty, slug) before they are merged; a concept of both kinds is related.
    """
    if min_confidence is not None:
        edges = edges.where(F.col("confidence").cast("double") >= min_confidence)
    rel = edges.where("relation = 'related_to'")
    ways = rel.select(F.col("source_id").alias("seed"), F.col("target_id").alias("concept_id")).unionByName(rel.select(F.col("target_id").alias("seed"), F.col("source_id").alias("concept_id")))
    near = ways.join(seeds, "seed", "left_semi").distinct().withColumn("kind", F.lit("related"))
    part = edges.where("relation = 'part_of'").select("source_id", "target_id").distinct()
    mine = part.join(seeds, part["source_id"] == seeds["seed"]).select("seed", "target_id")
    # a parent's k + 1 first children are enough for each of them to have its k first siblings
    children = part.join(concepts.select(F.col("concept_id").alias("source_id"), "difficulty", "slug"), "source_id")
    children = written(top_k(children, ["target_id"], [F.asc("difficulty"), F.asc("slug"), F.asc("source_id")], k + 1, "_n"), "children")
    sisters = mine.join(children.select(F.col("source_id").alias("concept_id"), "target_id"), "target_id").where("concept_id <> seed").select("seed", "concept_id").distinct().withColumn("kind", F.lit("sibling"))
    named = near.unionByName(sisters).where("concept_id <> seed").join(concepts.select("concept_id", "difficulty", "slug"), "concept_id")
    cut = top_k(named, ["seed", "kind"], [F.asc("difficulty"), F.asc("slug")], k, "_n").drop("_n")
    first = Window.partitionBy("seed", "concept_id").orderBy("kind")
    once = cut.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return top_k(once, ["seed"], [F.asc("difficulty"), F.asc("slug")], k)


def knowledge_gap(goals: DataFrame, mastery: DataFrame, edges: DataFrame, concepts: DataFrame, threshold: float = 0.6, max_depth: int = MAX_DEPTH, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """seed, concept_id, depth, mastery, never_assessed, difficulty, rank: what a learner lacks, deepest first.

    ``goals`` (seed[, user_id]) and ``mastery`` ([user_id,] concept_id, mastery).
    """
    keys = [c for c in ("user_id",) if c in goals.columns and c in mastery.columns]
    found = walks(goals.select("seed").distinct(), _steps(edges, "requires", min_confidence), max_depth)
    depth = found.groupBy("seed", "concept_id").agg(F.min("depth").alias("depth"), F.min_by("path", F.struct("depth", "path")).alias("path"))
    mine = depth.join(goals, "seed").join(mastery.select(*keys, "concept_id", F.col("mastery").alias("measured")), [*keys, "concept_id"], "left")
    rows = mine.where(F.coalesce("measured", F.lit(0.0)) < threshold).join(concepts.select("concept_id", "difficulty", "slug"), "concept_id")
    rows = rows.select(*keys, "seed", "concept_id", "depth", "path", F.coalesce("measured", F.lit(0.0)).alias("mastery"), F.col("measured").isNull().alias("never_assessed"), "difficulty", "slug")
    order = Window.partitionBy(*keys, "seed").orderBy(F.desc("depth"), "difficulty", F.desc("never_assessed"), "slug")
    return rows.withColumn("rank", F.row_number().over(order))


def on_cycles(steps: DataFrame, enough: int = 0) -> DataFrame:
    """``steps`` without those from a source or to a sink, round by round until none is left of these, or at most ``enough`` steps are."""
    steps = written(steps, "steps")
    before = steps.count()
    while before > enough:
        inner = steps.join(steps.select(F.col("to").alias("at")).distinct(), "at", "left_semi")
        steps = written(inner.join(inner.select(F.col("at").alias("to")).distinct(), "to", "left_semi"), "steps")
        after = steps.count()
        if after == before:
            break
        before = after
    return steps.select("at", "to")


def cycles(edges: DataFrame, seeds: DataFrame | None = None, max_path: int = MAX_PATH) -> DataFrame:
    """path of every cycle of up to ``max_path`` concepts over requires and part_of, at any confidence.

    Each round's open paths are written; rounds end when there are none.
    """
    steps = on_cycles(_steps(edges, TRANSITIVE, None).select("at", "to").distinct())
    starts = (seeds if seeds is not None else steps.select(F.col("at").alias("seed"))).distinct()
    open_, found = starts.select(F.array("seed").alias("path"), F.col("seed").alias("last")), None
    back = F.col("to") == F.col("path")[0]
    for _ in range(max_path):
        ahead = open_.join(steps, F.col("last") == F.col("at")).where(back | ~F.array_contains("path", F.col("to")))
        level = written(ahead.select(F.concat("path", F.array("to")).alias("path"), F.col("to").alias("last"), back.alias("closed")), "paths")
        here = level.where("closed").select("path")
        found = here if found is None else found.unionByName(here)
        open_ = level.where("not closed").select("path", "last")
        if open_.isEmpty():
            break
    return found.distinct()


def would_cycle(proposed: DataFrame, edges: DataFrame, relation: str = "requires", max_depth: int = MAX_PATH) -> DataFrame:
    """proposed (source_id, target_id) and whether target already leads to source. Frontiers are sets, so each round is linear; they are written, and rounds end when nothing is new."""
    steps = written(_steps(edges, relation, None).select("at", "to").distinct(), "steps")
    pairs = ["source_id", "target_id"]
    seen = frontier = written(proposed.select(*pairs, F.col("target_id").alias("here")).distinct(), "frontier")
    for _ in range(max_depth):
        ahead = frontier.where("here <> source_id").join(steps, F.col("here") == F.col("at")).select(*pairs, F.col("to").alias("here")).distinct()
        frontier = written(ahead.join(seen, [*pairs, "here"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    hit = seen.where("here = source_id").select(*pairs).distinct().withColumn("hit", F.lit(True))
    return proposed.join(hit, pairs, "left").withColumn("would_cycle", F.coalesce("hit", F.lit(False))).drop("hit")


def closure_edges(seeds: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """seed, source_id, target_id: requires edges that start in a seed's closure or at the seed."""
    inside = walks(seeds, _steps(edges, "requires", min_confidence), max_depth).select("seed", F.col("concept_id").alias("source_id")).unionByName(seeds.select("seed", F.col("seed").alias("source_id"))).distinct()
    strong = edges.where((F.col("relation") == "requires") & (F.col("confidence").cast("double") >= min_confidence))
    return inside.join(strong.select("source_id", "target_id"), "source_id").select("seed", "source_id", "target_id").distinct()


def edges_between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges in either direction between the concepts of each pair (a, b)."""
    canonical = pairs.select("a", "b", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    return edges.withColumn("low", F.least("source_id", "target_id")).withColumn("high", F.greatest("source_id", "target_id")).join(canonical, ["low", "high"]).drop("low", "high")


def resolve(mentions: DataFrame, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention and its concept: by id, else slug, else name without case, else alias; least id among equals.

    A mention is looked up once, and a key that many concepts share names the least
    of them before it meets the mentions, so that each way gives a mention one row.
    """
    asked = mentions.select("mention").distinct()
    asked = asked.select("mention", F.lower(F.trim("mention")).alias("_name"))
    names = [("mention", concepts.select("concept_id", F.col("concept_id").cast("string").alias("_key"))), ("mention", concepts.select("concept_id", F.col("slug").alias("_key"))),
        ("_name", concepts.select("concept_id", F.lower("name").alias("_key"))), ("_name", aliases.select("concept_id", F.col("alias_norm").alias("_key")))]
    found = None
    for way, (said, keyed) in enumerate(names, 1):
        least = keyed.groupBy("_key").agg(F.min(F.struct("concept_id"))["concept_id"].alias("concept_id"))
        rows = asked.join(least, F.col(said) == F.col("_key")).select("mention", "concept_id", F.lit(way).alias("way"))
        found = rows if found is None else found.unionByName(rows)
    best = found.groupBy("mention").agg(F.min(F.struct("way", "concept_id")).alias("best"))
    return asked.select("mention").join(best, "mention", "left").select("mention", "best.concept_id", "best.way")


def search(seeds: DataFrame, edges: DataFrame, concepts: DataFrame, direction: str = "both", k: int = 20, relation: str = "requires", **limits) -> DataFrame:
    """Prerequisites, dependents or both with their direction, by (depth, slug).

    A relation that is not transitive has no closure: its rows are one hop away,
    ``direction`` is the relation itself, and they keep the order of the lookup.
    """
    if relation not in TRANSITIVE:
        floor = limits.get("min_confidence", MIN_CONFIDENCE)
        if relation == "related_to":
            rows = related(seeds, edges, concepts, k, floor).select("seed", "concept_id", "slug", "rank")
        else:
            rows = direct(seeds, edges, concepts, relation, k, floor).select(F.col("source_id").alias("seed"), F.col("target_id").alias("concept_id"), "slug", "rank")
        return rows.withColumn("depth", F.lit(1)).withColumn("direction", F.lit(relation))
    limits["relation"] = relation
    sides = {"prerequisites": False, "dependents": True}
    parts = [closure(seeds, edges, concepts, reverse=r, **limits).drop("rank").withColumn("direction", F.lit(n)) for n, r in sides.items() if direction in (n, "both")]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return top_k(rows, ["seed"], [F.asc("depth"), F.asc("slug"), F.asc("direction")], k)
