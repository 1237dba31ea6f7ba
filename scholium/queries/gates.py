"""What batches add to the concept graph: gates in order, aliases."""

from pyspark.sql import functions as F

from scholium.operators import gates as G
from scholium.queries.tables import table
from scholium.registry import query


def proposals(spark, d):
    """Relations that orders stand for: mostly from a concept to an easier one, some back up."""
    k, a = F.col("o_orderkey"), F.col("o_custkey")
    up = F.when(k % 5 == 0, k % 4 < 2).otherwise(k % 23 == 0)
    rows = table(spark, d, "orders").select(
        a.cast("long").alias("source_id"), F.when(up, a + 1 + k % 50).otherwise(F.floor(a * (k % 89) / 89)).cast("long").alias("target_id"), F.when(k % 71 == 0, "likes").when(k % 5 == 0, "part_of").otherwise("requires").alias("relation"),
        F.when(F.col("o_orderstatus") == "P", "inferred").otherwise("explicit").alias("cue"), ((F.col("o_totalprice") * 100).cast("long") % 100 / 100.0).alias("model_confidence"),
        F.floor(k / 40).alias("document_id"), F.floor(k / 8).alias("chunk_id"), (k % 8).alias("seq"), k.alias("_k"))
    name = lambda c: F.concat(F.lit("Concept "), F.col(c).cast("string"))
    said = F.concat(name("source_id"), F.lit(" builds on "), name("target_id"))
    quote = F.when(F.col("_k") % 37 == 0, F.concat(F.lit("# "), said)).when(F.col("_k") % 41 == 0, "said nowhere at all").otherwise(said)
    return rows.select("*", name("source_id").alias("source_name"), name("target_id").alias("target_name"), quote.alias("quote"), F.concat(F.lit("In short: "), said, F.lit(".")).alias("chunk_text")).drop("_k")


def known_edges(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").where("c_custkey > 0")
    return rows.select(k.cast("long").alias("source_id"), F.floor(k / 3).cast("long").alias("target_id"), F.when(k % 2 == 0, "requires").otherwise("part_of").alias("relation"), (k % 4 < 2).alias("verified"))


@query("graph_update")
def graph_update(spark, d):
    """Every edge that the batch proposes, with its score and the gate that refused it: a fold in order, without SQL."""
    batch = G.admitted(proposals(spark, d), known_edges(spark, d), per_chunk=6, per_document=20)
    return batch.edges.select("source_id", "target_id", "relation", "confidence", "disposition", "gate")


@query("graph_update_gates")
def graph_update_gates(spark, d):
    """How often each gate fired."""
    return G.admitted(proposals(spark, d), known_edges(spark, d), per_chunk=6, per_document=20).counts()


ALIAS_SQL = r"""WITH a AS (SELECT p_brand AS tenant_id, CASE WHEN p_size % 5 <> 0 THEN p_type END AS course_id, p_partkey AS concept_id, unnest([p_name, p_type || ' ' || p_name, '(' || p_size || ')', '?!']) AS alias, p_partkey * 4 + unnest([0, 1, 2, 3]) AS seq FROM part),
  n AS (SELECT *, nullif(trim(regexp_replace(lower(alias), '[^a-z0-9]+', '-', 'g'), '-'), '') AS alias_norm FROM a),
  stored AS (SELECT tenant_id, course_id, alias_norm, max(concept_id) AS concept_id FROM n WHERE concept_id % 7 = 3 AND alias_norm IS NOT NULL GROUP BY ALL),
  first AS (SELECT n.tenant_id, n.course_id, n.alias_norm, coalesce(any_value(s.concept_id), arg_min(n.concept_id, seq)) AS owner, CASE WHEN any_value(s.concept_id) IS NULL THEN min(seq) END AS first_seq
    FROM n LEFT JOIN stored s ON s.tenant_id = n.tenant_id AND s.course_id IS NOT DISTINCT FROM n.course_id AND s.alias_norm = n.alias_norm WHERE n.alias_norm IS NOT NULL GROUP BY ALL),
  judged AS (SELECT n.*, owner, CASE WHEN n.alias_norm IS NULL THEN 'empty_name' WHEN concept_id <> owner THEN 'alias_collision' END AS gate, coalesce(seq = first_seq, false) AS new
    FROM n LEFT JOIN first f ON f.tenant_id = n.tenant_id AND f.course_id IS NOT DISTINCT FROM n.course_id AND f.alias_norm = n.alias_norm)"""


def _aliases(spark, d):
    p = table(spark, d, "part")
    names = F.posexplode(F.array("p_name", F.concat_ws(" ", "p_type", "p_name"), F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")), F.lit("?!")))
    rows = p.select(F.col("p_brand").alias("tenant_id"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("course_id"), F.col("p_partkey").alias("concept_id"), names.alias("n", "alias"))
    rows = rows.select("tenant_id", "course_id", "concept_id", "alias", (F.col("concept_id") * 4 + F.col("n")).alias("seq"))
    slug = G.slugify(F.col("alias"))
    stored = rows.where("concept_id % 7 = 3").withColumn("alias_norm", slug).where(G.is_slug(slug)).groupBy("tenant_id", "course_id", "alias_norm").agg(F.max("concept_id").alias("concept_id"))
    return rows, stored


@query("alias_assignment", f"{ALIAS_SQL} SELECT tenant_id, course_id, concept_id, alias, alias_norm, owner, gate, new FROM judged")
def alias_assignment(spark, d):
    return G.assigned_aliases(*_aliases(spark, d)).select("tenant_id", "course_id", "concept_id", "alias", "alias_norm", "owner", "gate", "new")


@query("alias_table", f"{ALIAS_SQL} SELECT tenant_id, course_id, alias_norm, concept_id FROM stored UNION ALL SELECT tenant_id, course_id, alias_norm, concept_id FROM judged WHERE new")
def alias_table(spark, d):
    return G.alias_table(*_aliases(spark, d))
