"""Progress of learners, their plans, recommendations and assessments."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from scholium.operators.lexical import top_k
from scholium.store import small, written

# Half-life and windows in days, weights of mastery, thresholds.
HALF_LIFE, VELOCITY_DAYS, STALE_DAYS = 30.0, 28, 30
W_MEAN, W_BEST, W_LATEST = 0.5, 0.3, 0.2
MASTERED = 0.6
# Hours by difficulty, per prerequisite, and their limits.
HOURS, PER_PREREQUISITE, LEAST_HOURS, MOST_HOURS = (0.5, 1.0, 2.0, 3.5, 5.0), 0.5, 0.25, 40.0
# Parts of a recommendation's score, and trust by class.
W_COVERAGE, W_FIT, W_RECENCY, W_TRUST = 0.55, 0.20, 0.10, 0.15
SCORE_DIGITS = 6
TRUST = {"official": 1.0, "academic": 0.8, "community": 0.5, "unknown": 0.25}


def clip(x: Column) -> Column:
    return F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))


# ---- progress ----------------------------------------------------------------


def observations(events: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """user_id, concept_id, value, weight, at, seq: events first, then attempts once per concept named."""
    usable = events.where("concept_id is not null and occurred_at is not null and weight > 0")
    out = usable.select("user_id", "concept_id", clip(F.col("mastery")).alias("value"), F.col("weight").cast("double").alias("weight"), F.col("occurred_at").alias("at"), F.lit(0).alias("seq"))
    if attempts is not None:
        rows = attempts.where("created_at is not null").select("user_id", F.explode("concept_ids").alias("concept_id"), clip(F.col("score")).alias("value"), F.lit(1.0).alias("weight"), F.col("created_at").alias("at"), F.lit(1).alias("seq"))
        out = out.unionByName(rows.where("concept_id is not null"))
    return out


def seconds(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / 1e6


def mastery(rows: DataFrame) -> DataFrame:
    """user_id, concept_id, mastery from observations: decayed mean, best and latest.

    Age counts back from the learner's own latest observation. Of observations
    of one moment the first collected is the latest (larger value among equals).
    """
    reference = written(rows.groupBy("user_id").agg(F.max(seconds(F.col("at"))).alias("_now")), "latest-observations")  # so that Spark can split the join of a hot learner
    aged = rows.join(reference, "user_id").withColumn("_d", F.pow(F.lit(0.5), (F.col("_now") - seconds(F.col("at"))) / 86400.0 / HALF_LIFE))
    decayed = F.col("value") * F.col("_d")
    latest = F.max_by(decayed, F.struct(F.col("at"), -F.col("seq"), F.col("value")))
    parts = aged.groupBy("user_id", "concept_id").agg(
        F.sum(F.col("weight") * decayed).alias("s"), F.sum(F.col("weight") * F.col("_d")).alias("w"), F.max(decayed).alias("best"), latest.alias("latest"))
    return parts.select("user_id", "concept_id", F.round(clip(W_MEAN * F.col("s") / F.col("w") + W_BEST * F.col("best") + W_LATEST * F.col("latest")), 6).alias("mastery"))


def velocity(events: DataFrame, now: Column) -> DataFrame:
    """user_id, velocity: concepts mastered a week over the trailing window; null below two."""
    recent = (F.col("kind") == "concept_mastered") & (F.col("mastery") >= MASTERED) & (seconds(F.col("occurred_at")) > seconds(now) - VELOCITY_DAYS * 86400) & (seconds(F.col("occurred_at")) <= seconds(now))
    n = F.countDistinct(F.when(recent, F.col("concept_id")))
    return events.groupBy("user_id").agg(F.when(n >= 2, n / (VELOCITY_DAYS / 7.0)).alias("velocity"))


def weak(mastered: DataFrame, threshold: float = MASTERED) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("mastery", "concept_id")
    return mastered.where(F.col("mastery") < threshold).withColumn("place", F.row_number().over(order))


def last_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "concept_id").agg(F.max("at").alias("last_seen"))


def stale(rows: DataFrame, mastered: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """Concepts last seen strictly before now - days that the learner has a mastery of, oldest first."""
    old = last_seen(rows).join(mastered.select("user_id", "concept_id"), ["user_id", "concept_id"]).where(seconds(F.col("last_seen")) < seconds(now) - days * 86400)
    return old.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("last_seen", "concept_id")))


def attempt_counts(attempts: DataFrame) -> DataFrame:
    return attempts.select("user_id", F.explode("concept_ids").alias("concept_id")).groupBy("user_id", "concept_id").agg(F.count(F.lit(1)).alias("attempts"))


def overview(mastered: DataFrame, staled: DataFrame, speeds: DataFrame, most: int = 20) -> DataFrame:
    """One row a learner: weak concepts (at most ``most``), stale ones, velocity, what to do next."""
    w = weak(mastered).where(F.col("place") <= most).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "concept_id"))), lambda x: x["concept_id"]).alias("weak"))
    s = staled.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_stale"))
    out = mastered.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_concepts")).join(w, "user_id", "left").join(s, "user_id", "left").join(speeds, "user_id", "left")
    action = F.when(F.size(F.coalesce("weak", F.array().cast("array<long>"))) > 0, "revise_weak").when(F.col("n_stale") > 0, "refresh_stale").otherwise("continue")
    return out.withColumn("next_action", action)


# ---- plans -------------------------------------------------------------------


def effort(difficulty: Column, n_prerequisites: Column) -> Column:
    base = F.element_at(F.array(*map(F.lit, HOURS)), F.greatest(F.least(difficulty, F.lit(5)), F.lit(1)).cast("int"))
    return F.round(F.least(F.greatest(base + PER_PREREQUISITE * n_prerequisites, F.lit(LEAST_HOURS)), F.lit(MOST_HOURS)), 4)


def topological(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """plan_id, concept_id, position (null: on or behind a cycle).

    ``nodes`` (plan_id, concept_id, difficulty, verified, weight, slug) and
    ``needs`` (plan_id, concept_id, prerequisite). Of the concepts that are free,
    easier, verified, heavier, then by slug come first. A plan is a bounded closure, so
    each is one row of lists, of which many go to Python at once.
    """
    listed = needs.groupBy("plan_id", "concept_id").agg(F.collect_set("prerequisite").alias("needs"))
    row = F.struct("difficulty", (~F.col("verified")).alias("unverified"), (-F.col("weight")).alias("light"), "slug", "concept_id", F.coalesce("needs", F.array().cast(listed.schema["needs"].dataType)).alias("needs"))
    plans = nodes.join(listed, ["plan_id", "concept_id"], "left").groupBy("plan_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    placed = plans.select("plan_id", F.col("rows.concept_id").alias("concept_id"), _places(F.col("rows.concept_id"), F.col("rows.needs")).alias("position"))
    return placed.select("plan_id", F.explode(F.arrays_zip("concept_id", "position")).alias("p")).select("plan_id", "p.concept_id", "p.position")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _places(concepts: pa.Array, needs: pa.Array) -> pa.Array:
    """The place of each concept of a plan, whose concepts come in order of preference; null on or behind a cycle."""

    def places(plan: list, wanted: list) -> list:
        at = {c: i for i, c in enumerate(plan)}
        waits = [{at[x] for x in w if x in at and x != c} for c, w in zip(plan, wanted, strict=True)]
        behind: dict[int, list[int]] = {}
        for i in at.values():
            for j in waits[i]:
                behind.setdefault(j, []).append(i)
        free, place = [i for i in at.values() if not waits[i]], {}
        heapq.heapify(free)
        while free:
            i = heapq.heappop(free)
            place[i] = len(place)
            for j in behind.get(i, ()):
                waits[j].discard(i)
                if not waits[j]:
                    heapq.heappush(free, j)
        return [place.get(at[c]) for c in plan]

    return pa.array([places(c, n) for c, n in zip(concepts.to_pylist(), needs.to_pylist(), strict=True)], pa.list_(pa.int64()))


def plan(nodes: DataFrame, needs: DataFrame, mastered: DataFrame, hours_a_week: float = 5.0) -> DataFrame:
    """Ordered steps: plan_id, concept_id, position, hours, blocked_by, status, total_hours, weeks."""
    todo = nodes.join(mastered.select("plan_id", "concept_id"), ["plan_id", "concept_id"], "left_anti")
    open_ = needs.join(todo.select("plan_id", F.col("concept_id").alias("prerequisite")), ["plan_id", "prerequisite"])
    blocked = open_.groupBy("plan_id", "concept_id").agg(F.sort_array(F.collect_set("prerequisite")).alias("blocked_by"))
    fan_in = needs.groupBy("plan_id", "concept_id").agg(F.countDistinct("prerequisite").alias("n"))
    steps = topological(todo, needs).join(todo.select("plan_id", "concept_id", "difficulty"), ["plan_id", "concept_id"]).join(blocked, ["plan_id", "concept_id"], "left").join(fan_in, ["plan_id", "concept_id"], "left")
    whole = Window.partitionBy("plan_id")
    steps = steps.where("position is not null").withColumn("hours", effort(F.col("difficulty"), F.coalesce("n", F.lit(0)))).withColumn("status", step_status(F.col("position"), F.col("blocked_by")))
    total = F.round(F.sum("hours").over(whole), 4)
    return steps.select("plan_id", "concept_id", "position", "hours", "blocked_by", "status", total.alias("total_hours"), F.ceil(total / hours_a_week).alias("weeks"))


def step_status(position: Column, blocked_by: Column) -> Column:
    return F.when(position == 0, "available").when(F.coalesce(F.size(blocked_by), F.lit(0)) > 0, "blocked").otherwise("pending")


def unblocked(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Steps after completions (plan_id, concept_id): their blockers shrink; with none left they are available.

    Blockers meet the completions one by one, so that no step carries all that is done in its plan.
    """
    finished = done.select("plan_id", "concept_id").distinct()
    lists = steps.select("plan_id", "blocked_by").distinct()
    met = lists.select("plan_id", "blocked_by", F.explode("blocked_by").alias("concept_id")).join(finished, ["plan_id", "concept_id"], "left_semi").groupBy("plan_id", "blocked_by").agg(F.collect_set("concept_id").alias("met"))
    out = steps.join(met, ["plan_id", "blocked_by"], "left").join(finished.withColumn("done", F.lit(True)), ["plan_id", "concept_id"], "left")
    out = out.withColumn("blocked_by", F.array_except("blocked_by", F.coalesce("met", F.array().cast(steps.schema["blocked_by"].dataType))))
    status = F.when(F.col("done"), "completed").when((F.col("status") == "blocked") & (F.size("blocked_by") == 0), "available").otherwise(F.col("status"))
    return out.withColumn("status", status).select(steps.columns)


def adapted(steps: DataFrame, nodes: DataFrame, needs: DataFrame, mastered: DataFrame) -> DataFrame:
    """A revised plan: completed steps stay in front, mastered ones go, new ones come, the rest is ordered anew."""
    done = written(steps.where("status = 'completed'").select("plan_id", "concept_id", "position"), "completed-steps")
    rest = nodes.join(done.select("plan_id", "concept_id"), ["plan_id", "concept_id"], "left_anti").join(mastered.select("plan_id", "concept_id"), ["plan_id", "concept_id"], "left_anti")
    kept = done.withColumn("position", F.row_number().over(Window.partitionBy("plan_id").orderBy("position")) - 1)
    n = kept.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    later = topological(rest, needs).join(n, "plan_id", "left").select("plan_id", "concept_id", (F.col("position") + F.coalesce("n", F.lit(0))).alias("position"))
    return kept.select("plan_id", "concept_id", F.col("position").cast("long").alias("position"), F.lit(True).alias("completed")).unionByName(later.withColumn("completed", F.lit(False)))


def signature(steps: DataFrame) -> DataFrame:
    """plan_id and a hash of its ordered content: equal plans make no new revision."""
    listed = F.sort_array(F.collect_list(F.struct("position", "concept_id")))
    return steps.groupBy("plan_id").agg(F.sha2(F.to_json(listed), 256).alias("signature"))


def latest_revision(roadmaps: DataFrame, by=("user_id", "goal")) -> DataFrame:
    return top_k(roadmaps, list(by), [F.desc("revision")], 1, "_n").drop("_n")


def transition(step: DataFrame) -> DataFrame:
    """Adds refusal to (status, blocked_by, wanted)."""
    return step.withColumn("refusal", F.when((F.col("wanted").isin("in_progress", "completed")) & (F.size("blocked_by") > 0), "blocked").when((F.col("status") == "completed") & (F.col("wanted") != "completed"), "invalid"))


# ---- recommendation ----------------------------------------------------------


def gap_weight(measured: Column) -> Column:
    return F.greatest(F.lit(0.1), 1 - clip(F.coalesce(measured, F.lit(0.0))))


def difficulty_target(mastered: DataFrame) -> DataFrame:
    return mastered.groupBy("user_id").agg((1 + F.bround(F.avg("mastery") * 4, 0)).cast("int").alias("target"))


def recommend(resources: DataFrame, covers: DataFrame, gaps: DataFrame, target: int = 3, now_year: int = 2024, k: int = 10) -> DataFrame:
    """user_id, resource_id, coverage, score, rank: resources that cover a gap, best first, then by url.

    ``gaps`` (user_id, slug, mastery); coverage is the weight of a learner's gaps
    ``gaps`` (user_id, slug, mastery); coverage is the weight of a learner's gaps
    that a resource covers, of all of them. Resources of the same concepts cover the
    same of every learner's gaps, so each such set is cut to those that can be among
    its k best before it meets the learners, and a learner's sets to the k with the
    best first resource.
    """
    sets = covers.where("slug is not null").distinct().groupBy("resource_id").agg(F.sort_array(F.collect_set("slug")).alias("_slugs"))
    fit = 1 - F.abs(F.col("difficulty") - target) / 4.0
    age = F.when(F.col("year").isNull(), 0.5).otherwise(clip(1 - (now_year - F.col("year")) / 30.0))
    quality = 0.5 * age + 0.5 * F.coalesce(F.col("rating").cast("double") / 5.0, F.lit(0.5))
    trust = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv]), F.col("trust")), F.lit(TRUST["unknown"]))
    own = ["_fit", "_trust", "_quality"]
    rows = resources.select("resource_id", "url", fit.alias("_fit"), trust.alias("_trust"), quality.alias("_quality")).join(sets, "resource_id")
    rows = rows.withColumn("_own", W_FIT * F.col("_fit") + W_TRUST * F.col("_trust") + W_RECENCY * F.col("_quality"))
    # k resources that are better by more than the scores' last digit leave no place; of those alike in all but the url the k first will do
    kth = top_k(rows.select("_slugs", "_own"), ["_slugs"], [F.desc_nulls_last("_own")], k, "_n").where(F.col("_n") == k).select("_slugs", F.col("_own").alias("_kth"))
    able = rows.join(kth, "_slugs", "left").where(F.col("_kth").isNull() | (F.col("_own") >= F.col("_kth") - 2 * 10.0**-SCORE_DIGITS))
    able = top_k(able, ["_slugs", *own], [F.asc("url"), F.asc("resource_id")], k, "_n")
    lists = written(able.groupBy("_slugs").agg(F.collect_list(F.struct(*own, "url", "resource_id")).alias("_list")).withColumn("_set", F.monotonically_increasing_id()), "resource-sets")
    best = small(lists.select("_set", "_list"))

    def scored(coverage: Column, x: Column) -> Column:
        score = F.round(W_COVERAGE * coverage + W_FIT * x["_fit"] + W_TRUST * x["_trust"] + W_RECENCY * x["_quality"], SCORE_DIGITS)
        return F.struct(score.isNull().alias("none"), (-score).alias("minus"), x["url"].alias("url"), x["resource_id"].alias("resource_id"))

    weighted = gaps.select("user_id", "slug", gap_weight(F.col("mastery")).alias("w")).repartition("user_id").withColumn("all_w", F.sum("w").over(Window.partitionBy("user_id")))
    covered = weighted.join(small(lists.select("_set", F.explode("_slugs").alias("slug"))), "slug").groupBy("user_id", "_set").agg(F.sum("w").alias("w"), F.max("all_w").alias("all_w"))
    covered = covered.select("user_id", "_set", (F.col("w") / F.col("all_w")).alias("coverage"))
    ranked = F.transform("_list", lambda x: scored(F.col("coverage"), x))
    firsts = covered.join(best, "_set").select("user_id", "_set", "coverage", F.array_min(ranked).alias("_first"))
    near = top_k(firsts, ["user_id"], [F.asc("_first")], k, "_n").select("user_id", "_set", "coverage")
    found = near.join(best, "_set").withColumn("_r", F.explode(F.slice(F.sort_array(ranked), 1, k)))
    return top_k(found, ["user_id"], [F.asc("_r")], k).select("user_id", F.col("_r.resource_id").alias("resource_id"), F.round("coverage", 6).alias("coverage"), (-F.col("_r.minus")).alias("score"), "rank")


def unpersonalised(resources: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """user_id, resource_id, personalised, rank for learners without gaps: by trust, then title, then url.

    The order is the same for all of them, so it is cut to k rows once and only these meet the learners.
    """
    trust = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv]), F.col("trust")), F.lit(TRUST["unknown"]))
    best = resources.select("resource_id", trust.alias("trust"), "title", "url").orderBy(F.desc("trust"), "title", "url").limit(k)
    place = F.struct((-F.col("trust")).alias("t"), "title", "url", "resource_id")
    listed = best.agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["resource_id"]).alias("listed")).withColumn("_all", F.lit(0))
    every = users.select("user_id").distinct().withColumn("_all", F.lit(0)).join(F.broadcast(listed), "_all")  # one row of k ids
    return every.select("user_id", F.posexplode("listed").alias("p", "resource_id")).select("user_id", "resource_id", F.lit(False).alias("personalised"), (F.col("p") + 1).alias("rank"))


def uncovered(gaps: DataFrame, covers: DataFrame) -> DataFrame:
    """Gaps that no resource at all covers."""
    return gaps.select("user_id", "slug").distinct().join(covers.select("slug").distinct(), "slug", "left_anti")


def merged_gaps(explicit: DataFrame, remaining: DataFrame, weak_ones: DataFrame) -> DataFrame:
    """A learner's gaps from the first source that has any: named ones, open steps, weak concepts."""
    rows = [df.select("user_id", "slug", "mastery", "difficulty", F.lit(i).alias("source")) for i, df in enumerate((explicit, remaining, weak_ones))]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    first = every.withColumn("_f", F.min("source").over(Window.partitionBy("user_id"))).where("source = _f").drop("_f")
    order = Window.partitionBy("user_id").orderBy("mastery", F.desc("difficulty"), "slug")
    return first.distinct().withColumn("place", F.row_number().over(order))


def explained(ranked: DataFrame, covers: DataFrame, gaps: DataFrame) -> DataFrame:
    """Adds a sentence that names a recommendation's main gap and the next."""
    mine = ranked.select("user_id", "resource_id").join(covers, "resource_id").join(gaps, ["user_id", "slug"])
    order = F.sort_array(F.collect_list(F.struct(F.col("mastery"), (-F.col("difficulty")).alias("d"), F.col("slug"))))
    named = mine.groupBy("user_id", "resource_id").agg(order.alias("g"))
    text = F.concat(F.lit("Covers "), F.col("g")[0]["slug"], F.when(F.size("g") > 1, F.concat(F.lit(", then "), F.get("g", F.lit(1))["slug"])).otherwise(""))
    return ranked.join(named.select("user_id", "resource_id", text.alias("explanation")), ["user_id", "resource_id"], "left")


# ---- assessment --------------------------------------------------------------


def weighted_total(criteria: DataFrame) -> DataFrame:
    """item_id, total: weighted mean of clipped scores; 0 where no weight is left."""
    agg = criteria.groupBy("item_id").agg(F.sum(F.col("weight") * clip(F.col("score"))).alias("s"), F.sum("weight").alias("w"))
    return agg.select("item_id", F.round(F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0), 6).alias("total"))


def rubric_valid(given: Column, expected: Column) -> Column:
    return (F.size(given) == F.size(F.array_distinct(given))) & (F.array_sort(given) == F.array_sort(expected))


def multiple_choice(answer: Column, options: Column, correct: Column) -> Column:
    """Whether an answer (index from 0, letter A-D, or the option's text) names the correct option."""
    said = F.lower(F.trim(answer))
    at = F.when(said.rlike("^[0-9]+$"), said.try_cast("int")).when(said.rlike("^[a-d]$"), F.ascii(said) - 97).otherwise(F.array_position(F.transform(options, lambda x: F.lower(F.trim(x))), said).cast("int") - 1)
    return F.coalesce(at == correct, F.lit(False))


def event_kind(score: Column) -> Column:
    return F.when(score < 0.5, "concept_struggled").otherwise("concept_mastered")


def grounded(misconceptions: Column, available: Column) -> Column:
    """Misconceptions (structs with citations) that cite something available."""
    return F.filter(misconceptions, lambda m: F.size(F.array_intersect(m["citations"], available)) > 0)


def quiz_items(items: DataFrame, n: int = 10) -> DataFrame:
    """Adds gate, why a generated item is dropped, and its new number among the first n kept."""
    gate = F.when(F.trim(F.coalesce("stem", F.lit(""))) == "", "empty_stem").when(F.size("options") < 2, "too_few_options").when(F.size("options") != F.size(F.array_distinct("options")), "repeated_options").when(~F.col("correct").between(0, F.size("options") - 1), "bad_key").when(F.size("citations") == 0, "no_citation")
    out = items.withColumn("gate", gate)
    number = F.row_number().over(Window.partitionBy("quiz_id", F.col("gate").isNull()).orderBy("item_no"))
    return out.withColumn("number", F.when(F.col("gate").isNull(), number)).where(F.col("gate").isNotNull() | (F.col("number") <= n))
