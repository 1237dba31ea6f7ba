"""Study plans with their history: what changed when, and what is in force.

Revisions and their steps are only ever appended. A plan's content has a signature; a
planned batch adds a revision where the signature differs from that of the
newest one and nothing elsewhere, so applying a batch twice writes no row. Which
revision superseded which, and what is active or completed, is read off the rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from scholium.operators.lexical import top_k
from scholium.store import written

PLAN = ("user_id", "goal")
STEP = ("concept_id", "position", "status", "blocked_by", "hours")


def signatures(steps: DataFrame, by=PLAN) -> DataFrame:
    """by, signature, n_steps: of the steps' concepts, titles if there are any, states, open prerequisites and hours, in order."""
    said = ["concept_id", *(c for c in ("title",) if c in steps.columns), "status"]
    content = F.struct("position", *said, F.sort_array("blocked_by").alias("blocked_by"), F.round("hours", 6).alias("hours"))
    listed = F.transform(F.sort_array(F.collect_list(content)), lambda x: x.dropFields("position"))
    return steps.groupBy(*by).agg(F.sha2(F.to_json(listed), 256).alias("signature"), F.count(F.lit(1)).cast("long").alias("n_steps"))


def latest(revisions: DataFrame, by=PLAN) -> DataFrame:
    return top_k(revisions, list(by), [F.desc("revision")], 1, "_n").drop("_n")


@dataclass
class Change:
    """Rows to append: revisions (by, revision, signature, n_steps, valid_from, reason) and their steps (by, revision, and the steps' columns)."""

    revisions: DataFrame
    steps: DataFrame


def changes(revisions: DataFrame, planned: DataFrame, valid_from, reason: str = "", by=PLAN) -> Change:
    """What ``planned`` steps (by, concept_id, position, status, blocked_by, hours) add to ``revisions``.

    A plan that is not in ``revisions`` starts with revision 1; one whose newest
    revision has the same signature adds nothing; plans that are not planned here
    stay. ``valid_from`` is a value or a column of ``planned`` that is the same
    within a plan.
    """
    moment = valid_from if isinstance(valid_from, str) and valid_from in planned.columns else None
    new = signatures(planned, by)
    if moment:
        new = new.join(planned.groupBy(*by).agg(F.max(moment).alias("valid_from")), list(by))
    else:
        new = new.withColumn("valid_from", F.lit(valid_from))
    old = latest(revisions, by).select(*by, F.col("revision").alias("_revision"), F.col("signature").alias("_signature"))
    differs = F.col("_signature").isNull() | (F.col("_signature") != F.col("signature"))
    added = new.join(old, list(by), "left").where(differs).select(*by, (F.coalesce("_revision", F.lit(0)) + 1).cast("long").alias("revision"), "signature", "n_steps", "valid_from", F.lit(reason).alias("reason"))
    added = written(added, "new-revisions")
    return Change(added, planned.join(added.select(*by, "revision"), list(by)))


def history(revisions: DataFrame, steps: DataFrame, by=PLAN) -> DataFrame:
    """``revisions`` with superseded_by, valid_to and status: superseded, else completed if all steps are, else active."""
    done = steps.groupBy(*by, "revision").agg(F.bool_and(F.col("status") == "completed").alias("done"))
    after = Window.partitionBy(*by).orderBy("revision")
    rows = revisions.withColumn("superseded_by", F.lead("revision").over(after)).withColumn("valid_to", F.lead("valid_from").over(after)).join(done, [*by, "revision"], "left")
    status = F.when(F.col("superseded_by").isNotNull(), "superseded").when(F.col("done"), "completed").otherwise("active")
    return rows.withColumn("status", status).drop("done")


def as_of(revisions: DataFrame, moment, by=PLAN) -> DataFrame:
    """The revision of each plan that was in force at ``moment``."""
    return latest(revisions.where(F.col("valid_from") <= F.lit(moment)), by)


def active(told: DataFrame, user: str = "user_id", by=PLAN) -> DataFrame:
    """Of ``history`` rows each user's newest active plan; of equally new ones the first by name."""
    return top_k(told.where("status = 'active'"), [user], [F.desc("valid_from"), *(F.asc(c) for c in by), F.desc("revision")], 1, "_n").drop("_n")


def candidates(closure: DataFrame, steps: DataFrame, mastered: DataFrame, by=PLAN) -> DataFrame:
    """Concepts of a plan's closure (by, concept_id, ...) that are neither among its steps nor mastered."""
    key = [*by, "concept_id"]
    return closure.join(steps.select(key), key, "left_anti").join(mastered.select(key), key, "left_anti")


def adapted(steps: DataFrame, mastered: DataFrame, new: DataFrame | None = None, by=PLAN) -> DataFrame:
    """by, concept_id, position, status, blocked_by, hours, inserted: each plan after what its user has mastered.

    ``steps`` (by, concept_id, title, position, status, blocked_by, hours),
    ``mastered`` (by, concept_id), ``new`` (as ``steps``: what comes in, in order of
    position). Completed steps stay, others that are mastered go, new ones stand last
    unless something needs them earlier. Open prerequisites are those neither
    mastered nor completed; steps that wait for each other are left out. A plan is
    a bounded closure, so each is one row of lists, of which many go to Python at once.
    """
    key = [*by, "concept_id"]
    columns = [*key, "title", "position", "status", "blocked_by", "hours"]
    known = mastered.select(*key).distinct().withColumn("mastered", F.lit(True))
    rows = steps.select(columns).withColumn("inserted", F.lit(False))
    if new is not None:
        n = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
        fresh = new.select(columns).join(steps.select(key), key, "left_anti").join(known, key, "left_anti").join(n, list(by), "left")
        place = F.row_number().over(Window.partitionBy(*by).orderBy("position", "concept_id")) - 1
        rows = rows.unionByName(fresh.withColumn("position", (place + F.coalesce("_size", F.lit(0))).cast(steps.schema["position"].dataType)).drop("_size").withColumn("inserted", F.lit(True)))
    kept = rows.join(known, key, "left").where("status = 'completed' or mastered is null").drop("mastered")
    met = known.select(key).unionByName(steps.where("status = 'completed'").select(key))
    open_ = kept.select(*key, F.explode("blocked_by").alias("_need")).join(met.select(*by, F.col("concept_id").alias("_need")).distinct(), [*by, "_need"], "left_anti")
    needs = open_.groupBy(*key).agg(F.sort_array(F.collect_set("_need")).alias("needs"))
    joined = kept.drop("blocked_by").join(needs, key, "left").withColumn("blocked_by", F.coalesce("needs", F.array().cast(steps.schema["blocked_by"].dataType))).drop("needs")
    row = F.struct("position", "inserted", F.coalesce("title", F.lit("")).alias("title"), "concept_id", "status", "blocked_by", "hours")
    plans = joined.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    placed = plans.select(*by, F.col("rows"), _ordered(F.col("rows.concept_id"), F.col("rows.blocked_by")).alias("order"))
    ordered = placed.select(*by, F.posexplode(F.transform("order", lambda i: F.get("rows", i))).alias("place", "r")).withColumn("position", F.col("place").cast("long"))
    ordered = ordered.select(*by, *(F.col(f"r.{c}").alias(c) for c in ("concept_id", "status", "blocked_by", "hours", "inserted")), "position")
    whole = Window.partitionBy(*by)
    first = F.min(F.when(F.col("status") != "completed", F.col("position"))).over(whole)
    here = F.col("position") == F.col("_first")
    status = F.when(F.col("status") == "completed", "completed").when(F.size("blocked_by") > 0, "blocked").when(here & (F.col("status") == "in_progress"), "in_progress").when(here, "available").otherwise("pending")
    return ordered.withColumn("_first", first).withColumn("status", status).select(*key, "position", "status", "blocked_by", "hours", "inserted")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _ordered(concepts: pa.Array, needs: pa.Array) -> pa.Array:
    """Which rows of a plan can be put in order, in that order, each behind those that it waits for; rows come by preference, and the first of those that are free comes next."""

    def order(plan: list, wanted: list) -> list[int]:
        at = {c: i for i, c in enumerate(plan)}
        waits = [{at[x] for x in w if x in at} for w in wanted]
        behind: dict[int, list[int]] = {}
        for i, w in enumerate(waits):
            for j in w:
                behind.setdefault(j, []).append(i)
        free, place = [i for i, w in enumerate(waits) if not w], []
        heapq.heapify(free)
        while free:
            i = heapq.heappop(free)
            place.append(i)
            for j in behind.get(i, ()):
                waits[j].discard(i)
                if not waits[j]:
                    heapq.heappush(free, j)
        return place

    return pa.array([order(c, n) for c, n in zip(concepts.to_pylist(), needs.to_pylist(), strict=True)], pa.list_(pa.int32()))


class Plans:
    """Revisions and steps below ``path``. A batch is one numbered folder in each table; it counts once its revisions are written, which come last."""

    def __init__(self, spark, path: str, by=PLAN):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by

    def _numbers(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/revisions")
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        parts = [x.getPath() for x in files.listStatus(where) if x.isDirectory()]
        return sorted(int(p.getName().split("=")[1]) for p in parts if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def table(self, name: str) -> DataFrame | None:
        """revisions or steps of the batches that count; None before the first."""
        done = self._numbers()
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/batch={n}" for n in done)).drop("batch") if done else None

    def apply(self, planned: DataFrame, valid_from, reason: str = "") -> int:
        """Appends what ``planned`` changes; the number of new revisions. Without a change nothing is written."""
        kinds = [f"{c} {planned.schema[c].dataType.simpleString()}" for c in self.by]
        none = self.spark.createDataFrame([], ", ".join([*kinds, "revision long", "signature string"]))
        done = self._numbers()
        change = changes(self.table("revisions") if done else none, planned, valid_from, reason, self.by)
        n = change.revisions.count()
        if n:
            at = max(done, default=-1) + 1
            change.steps.write.mode("overwrite").parquet(f"{self.path}/steps/batch={at}")
            change.revisions.write.mode("overwrite").parquet(f"{self.path}/revisions/batch={at}")
        return n

    def history(self) -> DataFrame:
        return history(self.table("revisions"), self.table("steps"), self.by)
