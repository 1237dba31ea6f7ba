"""From extracted relations to scored edges of the concept graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from scholium.functions.text import folded, is_slug, slugify
from scholium.store import written

# Weights of the confidence and the limits of its dispositions.
BASE, W_MODEL, W_CORROBORATION, W_CUE, W_AGREEMENT, MODEL_CAP = 0.15, 0.25, 0.30, 0.20, 0.10, 0.8
DISCARD, AUTO, AUTO_DOCS = 0.5, 0.75, 2
CHUNK_EDGES, DOCUMENT_EDGES = 20, 200


def corroboration(n_docs: Column) -> Column:
    return 1 - F.exp(-n_docs / 2.0)


def cue_score(cue: Column, structural: Column) -> Column:
    return F.when(cue == "explicit", 1.0).when(structural, 0.4).otherwise(0.0)


def agreement(opposite: Column, same_verified: Column, path: Column) -> Column:
    """How far the graph bears an edge out; a verified edge the other way counts unless the edge itself is verified too."""
    return F.when(same_verified, 1.0).when(opposite, 0.0).when(path, 0.7).otherwise(0.0)


def confidence(model: Column, corroborated: Column, cue: Column, agree: Column) -> Column:
    raw = BASE + W_MODEL * F.least(model, F.lit(MODEL_CAP)) + W_CORROBORATION * corroborated + W_CUE * cue + W_AGREEMENT * agree
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def disposition(score: Column, cue: Column, n_docs: Column) -> Column:
    return F.when(score < DISCARD, "discard").when((score >= AUTO) & (cue == "explicit") & (n_docs >= AUTO_DOCS), "auto").otherwise("review")


def evidence(rows: DataFrame) -> DataFrame:
    """One row an edge of (source_id, target_id, relation, document_id, chunk_id, model_confidence, cue, quote)."""
    first = F.struct("document_id", "chunk_id", "quote")
    return rows.groupBy("source_id", "target_id", "relation").agg(
        F.max("model_confidence").alias("model_confidence"), F.max(F.when(F.col("cue") == "explicit", 1).otherwise(0)).alias("any_explicit"),
        F.countDistinct("document_id").alias("n_docs"), F.countDistinct("chunk_id").alias("n_chunks"), F.min(first).alias("provenance"))


def agreeing(edges: DataFrame, known: DataFrame, hops: int = 3) -> DataFrame:
    """Adds agreement of each edge with ``known`` edges (source_id, target_id, relation, verified): the same or the opposite one verified, or a path of up to ``hops`` edges of its relation."""
    keys = ["source_id", "target_id", "relation"]
    verified = known.where("verified").select(*keys).distinct()
    opposite = verified.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation")
    steps = known.select(F.col("source_id").alias("here"), F.col("target_id").alias("to"), "relation").distinct()
    reached = edges.select(*keys, F.col("source_id").alias("here")).distinct()
    met = None
    for _ in range(hops):
        ahead = reached.join(steps, ["here", "relation"]).select(*keys, F.col("to").alias("here")).distinct()
        here = ahead.where("here = target_id").select(*keys)
        met = here if met is None else met.unionByName(here)
        reached = ahead.where("here <> target_id")
    out = edges
    for name, rows in (("same", verified), ("opposite", opposite), ("path", met.distinct())):
        out = out.join(rows.withColumn(name, F.lit(True)), keys, "left")
    held = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumn("agreement", agreement(held("opposite"), held("same"), held("path"))).drop("same", "opposite", "path")


def scored(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds cue, confidence and disposition to evidence; ``known``: the graph that edges may agree with."""
    rows = edges.withColumn("agreement", F.lit(0.0)) if known is None else agreeing(edges, known)
    cue = F.when(F.col("any_explicit") == 1, "explicit").otherwise("inferred")
    score = confidence(F.col("model_confidence"), corroboration(F.col("n_docs")), cue_score(cue, F.col("n_chunks") > 1), F.col("agreement"))
    out = rows.withColumn("cue", cue).withColumn("confidence", F.round(score, 6)).drop("agreement")
    return out.withColumn("disposition", disposition(F.col("confidence"), F.col("cue"), F.col("n_docs")))


# Relations, the least length of a quote, and what marks one as boilerplate.
RELATIONS = ("requires", "contains", "related_to", "part_of", "assesses", "taught_by")
LEAST_QUOTE, BOILERPLATE = 10, r"^(?:[#\-*•|>]|\d+[.)]\s)"


def concept_gate(name: Column) -> Column:
    """Why a concept is refused: no name, or one that gives no slug."""
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "empty_name").when(~is_slug(slugify(name)), "unresolved_entity")


def gated(rows: DataFrame, allow_cross_course: bool = False) -> DataFrame:
    """Adds gate, the key of the first reason to refuse a row, or null.

    ``rows``: source_name, target_name, relation, cue, model_confidence,
    document_id, chunk_id, quote, chunk_text and, if known, source_course and
    target_course, or tenant_id with the chunk's own chunk_tenant_id and
    chunk_document_id. What is left goes through ``gates.admitted``.
    """
    source, target = F.trim(F.coalesce("source_name", F.lit(""))), F.trim(F.coalesce("target_name", F.lit("")))
    quote = F.trim(F.coalesce("quote", F.lit("")))
    foreign = F.lit(False)
    if {"tenant_id", "chunk_tenant_id", "chunk_document_id"} <= set(rows.columns):
        foreign = (F.col("chunk_tenant_id") != F.col("tenant_id")) | (F.col("chunk_document_id") != F.col("document_id"))
    gate = F.when(F.coalesce(foreign, F.lit(False)), "document_scope").when(F.col("model_confidence").isNull() | ~F.col("model_confidence").between(0, 1), "schema")
    gate = gate.when(~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False)), "relation_enum")
    gate = gate.when((F.lower(source) == F.lower(target)) | (slugify(source) == slugify(target)), "self_relation")
    gate = gate.when((F.col("relation") == "requires") & (F.col("cue") == "inferred"), "inferred_requires")
    gate = gate.when(F.col("document_id").isNull() | F.col("chunk_id").isNull() | (quote == ""), "missing_provenance")
    gate = gate.when((F.length(quote) < LEAST_QUOTE) | quote.rlike(BOILERPLATE) | ~quote.rlike("[A-Za-z]{3,}"), "quote_boilerplate")
    gate = gate.when(~F.contains(folded(F.col("chunk_text")), folded(quote)), "verbatim_provenance")
    gate = gate.when(concept_gate(source).isNotNull() | concept_gate(target).isNotNull(), "unresolved_entity")
    if not allow_cross_course and {"source_course", "target_course"} <= set(rows.columns):
        gate = gate.when(F.col("source_course") != F.col("target_course"), "cross_course")
    return rows.withColumn("gate", gate)


def capped(rows: DataFrame, per_chunk: int = CHUNK_EDGES, per_document: int = DOCUMENT_EDGES) -> DataFrame:
    """Accepted rows within the caps, by their place (seq) in the chunk, then in the document."""
    kept = rows.withColumn("_c", F.row_number().over(Window.partitionBy("chunk_id").orderBy("seq"))).where(F.col("_c") <= per_chunk)
    return kept.withColumn("_d", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_id", "seq"))).where(F.col("_d") <= per_document).drop("_c", "_d")


def selected_chunks(chunks: DataFrame, cues: list[str], cap: int = 200) -> DataFrame:
    """Chunks with the most cue phrases, by index among equals."""
    score = reduce(lambda a, b: a + b, (F.lower("text").contains(c).cast("int") for c in cues))
    ranked = chunks.withColumn("cue_score", score)
    order = Window.partitionBy("document_id").orderBy(F.desc("cue_score"), "chunk_index")
    return ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The edge table after an upsert (one row an edge on either side).

    Confidence and weight never fall, an explicit cue stays, sources add up;
    a verified edge is left as it is.
    """
    keys = ["source_id", "target_id", "relation"]
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, keys, "full_outer")
    pick = lambda c, e: F.when(F.col("a.verified"), F.col(f"a.{c}")).otherwise(e).alias(c)
    cue = F.when((F.col("a.cue") == "explicit") | (F.col("b.cue") == "explicit"), "explicit").otherwise(F.coalesce("a.cue", "b.cue"))
    count = F.coalesce("a.corroboration_count", F.lit(0)) + F.when(F.col("b.confidence").isNotNull(), 1).otherwise(0)
    empty = F.array().cast("array<string>")
    return both.select(*keys, pick("confidence", F.greatest("a.confidence", "b.confidence")), pick("weight", F.greatest("a.weight", "b.weight")),
        pick("corroboration_count", count), pick("cue", cue), pick("sources", F.concat(F.coalesce("a.sources", empty), F.coalesce("b.sources", empty))), F.coalesce("a.verified", F.lit(False)).alias("verified"))


def contradictory(edges: DataFrame) -> DataFrame:
    """source_id, target_id of the requires edges of a batch that cannot be put in order.

    Concepts without an open prerequisite are taken away, round by round, until
    nothing changes; all edges among the rest go, also those that lead into a
    cycle. Each round is written.
    """
    every = written(edges.select("source_id", "target_id").distinct(), "requires")
    open_, before = every.where("source_id <> target_id"), -1
    while True:
        waiting = open_.select(F.col("source_id").alias("target_id")).distinct()
        open_ = written(open_.join(waiting, "target_id", "left_semi").select("source_id", "target_id"), "open-requires")
        after = open_.count()
        if after in (0, before):
            break
        before = after
    stuck = open_.select("source_id").distinct()
    return every.join(stuck, "source_id", "left_semi").join(stuck.withColumnRenamed("source_id", "target_id"), "target_id", "left_semi").select("source_id", "target_id")


def run_summary(rows: DataFrame) -> DataFrame:
    """run_id, n_rows, n_accepted, rejections (gate -> count), status."""
    counts = rows.where("gate is not null").groupBy("run_id", "gate").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("gate", "n")))).alias("rejections"))
    totals = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("gate").isNull().cast("long")).alias("n_accepted"))
    status = F.when(F.col("n_accepted") == F.col("n_rows"), "succeeded").when(F.col("n_accepted") > 0, "partial").otherwise("failed")
    return totals.join(maps, "run_id", "left").withColumn("status", status)
