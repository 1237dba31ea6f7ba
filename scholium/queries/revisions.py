"""Plans through several batches: revisions, what is in force, adaptation."""

import uuid

from pyspark.sql import Window, functions as F

from scholium.operators import revisions as V
from scholium.queries.tables import table
from scholium.registry import query
from scholium.store import shared_folder

PLANS_SQL = """WITH o AS (SELECT c_nationkey AS user_id, o_custkey AS goal, o_orderkey AS concept_id, o_orderstatus = 'F' AS done, o_totalprice, year(o_orderdate) AS y FROM orders JOIN customer ON c_custkey = o_custkey),
  batch AS (SELECT * FROM (VALUES (1, 1996), (2, 1996), (3, 1997), (4, 1999)) v(batch, upto)),
  plan AS (SELECT batch, user_id, goal, count(*) AS n_steps, bool_and(done) AS done, list(concept_id ORDER BY concept_id) AS content FROM o JOIN batch ON y <= upto GROUP BY ALL),
  new AS (SELECT * FROM (SELECT *, lag(content) OVER (PARTITION BY user_id, goal ORDER BY batch) AS before FROM plan) WHERE before IS NULL OR before <> content),
  rev AS (SELECT *, row_number() OVER w AS revision, lead(batch) OVER w AS valid_to FROM new WINDOW w AS (PARTITION BY user_id, goal ORDER BY batch)),
  told AS (SELECT user_id, goal, revision, n_steps, batch::BIGINT AS valid_from, valid_to::BIGINT AS valid_to, CASE WHEN valid_to IS NOT NULL THEN revision + 1 END AS superseded_by,
    CASE WHEN valid_to IS NOT NULL THEN 'superseded' WHEN done THEN 'completed' ELSE 'active' END AS status FROM rev)"""


def planned(spark, d, upto):
    """The plan of each customer: its orders up to a year, as steps."""
    rows = table(spark, d, "orders").where(F.year("o_orderdate") <= upto).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    none = F.array().cast("array<bigint>")
    return rows.select(F.col("c_nationkey").alias("user_id"), F.col("o_custkey").alias("goal"), F.col("o_orderkey").cast("long").alias("concept_id"), F.col("o_orderpriority").alias("title"), place.cast("long").alias("position"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"), none.alias("blocked_by"), F.round(F.col("o_totalprice") / 1e4, 2).alias("hours"))


def plans(spark, d):
    """Four batches, of which the second is the first once more."""
    store = V.Plans(spark, f"{shared_folder(spark)}/plans-{uuid.uuid4().hex}")
    for batch, upto in ((1, 1996), (2, 1996), (3, 1997), (4, 1999)):
        store.apply(planned(spark, d, upto), batch, f"up to {upto}")
    return store


@query("plan_revisions", f"{PLANS_SQL} SELECT user_id, goal, revision, n_steps, valid_from, valid_to, superseded_by, status FROM told")
def plan_revisions(spark, d):
    rows = plans(spark, d).history()
    return rows.select("user_id", "goal", "revision", "n_steps", F.col("valid_from").cast("long").alias("valid_from"), F.col("valid_to").cast("long").alias("valid_to"), "superseded_by", "status")


@query("active_plans", f"{PLANS_SQL} SELECT user_id, goal, revision, n_steps FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_from DESC, goal, revision DESC) AS n FROM told WHERE status = 'active') WHERE n = 1")
def active_plans(spark, d):
    return V.active(plans(spark, d).history()).select("user_id", "goal", "revision", "n_steps")


@query("plans_as_of", f"{PLANS_SQL} SELECT user_id, goal, revision FROM told WHERE valid_from <= 3 AND (valid_to IS NULL OR valid_to > 3)")
def plans_as_of(spark, d):
    """What was in force when the third batch had come."""
    return V.as_of(plans(spark, d).table("revisions"), 3).select("user_id", "goal", "revision")


def adaptation(spark, d):
    """Steps, mastered concepts and candidates of every customer's plan."""
    k = F.col("concept_id")
    steps = planned(spark, d, 1997)
    before = Window.partitionBy("goal").orderBy("position")
    needs = F.array_compact(F.array(F.lag("concept_id", 1).over(before), F.when(k % 3 == 0, F.lag("concept_id", 2).over(before)), F.when(k % 7 == 0, F.lead("concept_id", 1).over(before))))
    steps = steps.withColumn("status", F.when(F.col("status") == "completed", "completed").when(k % 4 == 0, "in_progress").otherwise("pending")).withColumn("blocked_by", F.when(k % 2 == 0, needs).otherwise(F.col("blocked_by")))
    mastered = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").where("o_orderkey % 5 = 1").select(F.col("c_nationkey").alias("user_id"), F.col("o_custkey").alias("goal"), F.col("o_orderkey").cast("long").alias("concept_id"))
    closure = planned(spark, d, 1999).withColumn("status", F.lit("pending")).withColumn("blocked_by", F.when(k % 2 == 1, F.array(k - 1, k - 2)).otherwise(F.col("blocked_by")))
    return steps, mastered, V.candidates(closure, steps, mastered)


@query("plan_adaptation")
def plan_adaptation(spark, d):
    """Every plan after what is mastered and what is new; a fold in order, without SQL."""
    return V.adapted(*adaptation(spark, d)).withColumn("blocked_by", F.to_json("blocked_by"))
