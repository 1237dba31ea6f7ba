"""Filters, pages, routing and plan checks around retrieval and roadmaps."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window, functions as F

from scholium.functions.text import host_of
from scholium.operators import learning
from scholium.operators.lexical import top_k
from scholium.scope import TenantScope

# Passages per retriever, catalogue rows that a source search scans, hours of a degraded plan, the rubric of free text.
RETRIEVER_K, SCAN_ROWS, DEGRADED_HOURS = 20, 500, 3.0
RUBRIC = {"correctness": 0.5, "reasoning": 0.3, "grounding": 0.2}


@dataclass(frozen=True)
class Filters:
    course_id: object = None
    document_id: object = None
    topic: str | None = None
    page: int | None = None
    source_types: tuple[str, ...] = ()

    def active(self) -> list[str]:
        """Names of the filters that are set, never their values."""
        return [f.name for f in fields(self) if getattr(self, f.name) not in (None, ())]


def filtered(chunks: DataFrame, scope: TenantScope, filters: Filters = Filters(), documents: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """A tenant's chunks under the filters; switched off, only tenancy is left.

    Source types are a semi-join with ``documents``, so that no chunk is doubled.
    """
    rows = scope.rows(chunks)
    if not enabled:
        return rows
    for name in ("course_id", "document_id", "topic", "page"):
        if getattr(filters, name) is not None:
            rows = rows.where(F.col(name) == F.lit(getattr(filters, name)))
    if filters.source_types:
        if documents is None:
            raise ValueError("source types need the documents")
        rows = rows.join(scope.rows(documents).where(F.col("source_type").isin(*filters.source_types)).select("document_id"), "document_id", "left_semi")
    return rows


def ready(documents: DataFrame, course_id=None) -> DataFrame:
    rows = documents.where("status = 'ready'")
    return rows if course_id is None else rows.where(F.col("course_id") == F.lit(course_id))


def pages(rows: DataFrame, by: list[str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Each owner's rows offset + 1 to offset + limit in order, with place and the owner's total."""
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    return top_k(rows, by, order, offset + limit, "place").where(F.col("place") > offset).join(totals, by)


def course_concepts(concepts: DataFrame, k: int) -> DataFrame:
    return top_k(concepts, ["course_id"], [F.asc("difficulty"), F.asc("name"), F.asc("concept_id")], k)


def web_sources(resources: DataFrame, domains: list[str], k: int, scan: int = SCAN_ROWS) -> DataFrame:
    """The first k resources, by title and url, on a listed domain or below it; nothing is fetched.

    As a search page does, only the first ``scan`` resources are looked at.
    """
    host = host_of(F.col("url"))
    listed = F.lit(False)
    for d in domains:
        listed = listed | (host == d) | host.endswith(f".{d}")
    return resources.orderBy("title", "url").limit(scan).where(listed).orderBy("title", "url").limit(k)


def retrieval_plan(calls: DataFrame, most: int = RETRIEVER_K) -> DataFrame:
    """turn_id, queries, k, course_id, dropped of (turn_id, seq, query, k, course_id, scoped_course, question).

    k is the first that is asked for, within 1 and ``most``; a course other than
    the turn's own is dropped; without a query the question itself is one.
    """
    listed = F.sort_array(F.collect_list(F.struct("seq", "query", "k", "course_id")))
    by = calls.groupBy("turn_id").agg(listed.alias("c"), F.first("scoped_course").alias("scoped"), F.first("question").alias("question"))
    named = F.filter(F.transform("c", lambda x: x["query"]), lambda q: q.isNotNull() & (q != ""))
    first = lambda name: F.get(F.filter(F.transform("c", lambda x: x[name]), lambda v: v.isNotNull()), F.lit(0))
    asked = first("course_id")
    return by.select(
        "turn_id", F.when(F.size(named) > 0, named).otherwise(F.array("question")).alias("queries"),
        F.least(F.greatest(F.coalesce(first("k"), F.lit(most)), F.lit(1)), F.lit(most)).cast("int").alias("k"),
        F.when(asked.isNull() | (asked == F.col("scoped")), F.col("scoped")).alias("course_id"), (asked.isNotNull() & ~asked.eqNullSafe(F.col("scoped"))).alias("dropped"))


def raised_floor(asked: Column, configured: float) -> Column:
    """A caller may raise the confidence floor, never lower it."""
    return F.greatest(F.coalesce(asked.cast("double"), F.lit(configured)), F.lit(configured))


def fallback_roadmap(entities: DataFrame) -> DataFrame:
    """Entities of a seed in order of (depth, name), for want of a planner."""
    order = Window.partitionBy("seed").orderBy("depth", "name", "concept_id")
    return entities.withColumn("position", F.row_number().over(order) - 1)


def degraded_plan(goals: DataFrame, hours: float = DEGRADED_HOURS) -> DataFrame:
    """One available step, named after the course or the goal, for goals that resolve to nothing."""
    title = F.substring(F.coalesce("course_name", F.when(F.col("goal_text") != "", F.col("goal_text")), F.lit("Learning goal")), 1, 300)
    return goals.where("concept_id is null").select("plan_id", title.alias("title"), F.lit(0).alias("position"), F.lit("available").alias("status"), F.lit(hours).alias("hours"), F.array(F.lit("goal_unresolved")).alias("degraded"))


def revision_checks(revisions: DataFrame) -> DataFrame:
    """Adds discards_completed and steps_recomputed to (completed, preserved, requested, computed)."""
    recomputed = (F.size("requested") > 0) & (F.col("requested") != F.col("computed"))
    return revisions.withColumn("discards_completed", F.size(F.array_except("completed", "preserved")) > 0).withColumn("steps_recomputed", recomputed)


def minutes(hours: Column) -> Column:
    return F.bround(hours * 60, 0).cast("long")


def narrowed(progress: DataFrame, column: str, wanted: Column) -> DataFrame:
    """A map by concept with the wanted concepts alone; null wants all."""
    return progress.withColumn(column, F.when(wanted.isNull(), F.col(column)).otherwise(F.map_filter(column, lambda k, v: F.array_contains(wanted, k))))


def mastery_delta(events: DataFrame) -> DataFrame:
    """user_id, concept_id, delta: what a learner's last event (by time, then event_id) did to its concept."""
    last = events.groupBy("user_id").agg(F.max(F.struct("occurred_at", "event_id")).alias("m"), F.max_by("concept_id", F.struct("occurred_at", "event_id")).alias("concept_id"))
    marked = events.join(last.select("user_id", "m"), "user_id")
    before = learning.mastery(learning.observations(marked.where(F.struct("occurred_at", "event_id") != F.col("m")).drop("m"))).withColumnRenamed("mastery", "before")
    after = learning.mastery(learning.observations(events)).withColumnRenamed("mastery", "after")
    keys = ["user_id", "concept_id"]
    both = last.select(*keys).join(after, keys, "left").join(before, keys, "left")
    return both.select(*keys, F.round(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 6).alias("delta"))


# ---- models and metrics ------------------------------------------------------


def provider(model: Column) -> Column:
    """What stands before the first slash, else unknown."""
    name = F.trim(F.substring_index(F.trim(model), "/", 1))
    return F.when(F.contains(F.trim(model), F.lit("/")) & (name != ""), name).otherwise("unknown")


def model_for(task: Column, primary: str, fast: str, reasoning: str, routing: bool = True) -> Column:
    if not routing:
        return F.lit(primary)
    return F.when(task.isin("classification", "extraction"), fast).when(task == "tutoring", primary).otherwise(reasoning)


def fallback_chain(first: Column, fallback: Column) -> Column:
    """The models to try in order, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(F.array(first, fallback), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def samples(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counters are summed and gauges keep their last value, per name, kind and labels."""
    last = F.max_by("value", F.struct("at", "seq"))
    return rows.groupBy("name", "kind", *by).agg(F.when(F.col("kind") == "gauge", last).otherwise(F.sum("value")).alias("value"))
