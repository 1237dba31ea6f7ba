"""The domain's tables, derived from the driver's, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scholium.functions.text import STOPWORDS
from scholium.operators.lexical import analysed

STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)


def tokens_sql(text: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9\-_.+]*'), lambda x: regexp_replace(x, '[\-_.]+$', '')), lambda x: x <> '')"


#: Common table expressions: chunks, terms, corpus, df, questions, qterms, scored.
CHUNKS_SQL = f"chunks AS (SELECT source AS tenant_id, doc_id AS chunk_id, lang AS course_id, text, {tokens_sql('text')} AS tokens, len({tokens_sql('text')}) AS token_count FROM documents)"
TERMS_SQL = f"terms AS (SELECT tenant_id, chunk_id, term, count(*) AS tf FROM (SELECT tenant_id, chunk_id, unnest(tokens) AS term FROM chunks) WHERE term NOT IN ({STOP_SQL}) GROUP BY ALL)"
STATS_SQL = "corpus AS (SELECT tenant_id, count(*) AS doc_count, sum(token_count)::BIGINT AS total_tokens, avg(token_count) AS avg_doc_len FROM chunks GROUP BY tenant_id), df AS (SELECT tenant_id, term, count(*) AS doc_freq FROM terms GROUP BY ALL)"
QUESTIONS_SQL = f"questions AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS tenant_id, text FROM benchmark), qterms AS (SELECT DISTINCT query_id, tenant_id, term FROM (SELECT query_id, tenant_id, unnest({tokens_sql('text')}) AS term FROM questions) WHERE term NOT IN ({STOP_SQL}))"
BM25_SQL = """scored AS (
    SELECT query_id, tenant_id, chunk_id, round(sum(ln(1 + (doc_count - doc_freq + 0.5) / (doc_freq + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * token_count / avg_doc_len))), 6) AS score
    FROM terms JOIN qterms USING (tenant_id, term) JOIN df USING (tenant_id, term) JOIN corpus USING (tenant_id) JOIN chunks USING (tenant_id, chunk_id)
    GROUP BY ALL),
  lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 20)"""
RETRIEVAL_SQL = f"WITH {CHUNKS_SQL}, {TERMS_SQL}, {STATS_SQL}, {QUESTIONS_SQL}, {BM25_SQL}"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("course_id"), "text")
    return analysed(docs)


def questions(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("tenant_id"), "text")


EVENTS_SQL = """ev AS (SELECT user_id, event_id % 40 AS concept_id, CASE WHEN event_type = 'purchase' THEN 'concept_mastered' ELSE event_type END AS kind,
    least(value / 100.0, 1.0) AS mastery, 1.0 AS weight, epoch_us(ts) / 1e6 AS moment, ts AS occurred_at, event_id, event_type FROM events)"""


def progress_events(spark, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "concept_mastered").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("concept_id"), kind.alias("kind"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("mastery"), F.lit(1.0).alias("weight"), F.col("ts").alias("occurred_at"), "event_id")


def attempts(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.select("user_id", F.array(F.col("event_id") % 40, (F.col("event_id") + 7) % 40).alias("concept_ids"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"), F.col("ts").alias("created_at"))


CONCEPTS_SQL = """concepts AS (SELECT p_partkey AS concept_id, p_name AS name, 1 + p_size % 5 AS difficulty, p_partkey % 3 = 0 AS verified,
    'concept-' || p_partkey AS slug FROM part),
  edges AS (
    SELECT p_partkey AS source_id, p_partkey // 2 AS target_id, 'requires' AS relation, 0.5 + (p_partkey % 50) / 100.0 AS confidence, 0.1 + (p_partkey % 9) / 10.0 AS weight, p_partkey % 3 = 0 AS verified FROM part WHERE p_partkey >= 2
    UNION ALL SELECT p_partkey, p_partkey // 10, 'part_of', 0.5 + (p_partkey % 50) / 100.0, 0.1 + (p_partkey % 9) / 10.0, p_partkey % 3 = 0 FROM part WHERE p_partkey >= 10
    UNION ALL SELECT p_partkey, p_partkey + 7, 'related_to', 0.5 + (p_partkey % 50) / 100.0, 0.1 + (p_partkey % 9) / 10.0, p_partkey % 3 = 0 FROM part WHERE p_partkey + 7 <= (SELECT max(p_partkey) FROM part))"""


def concepts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"), (1 + F.col("p_size") % 5).alias("difficulty"), (F.col("p_partkey") % 3 == 0).alias("verified"), F.concat(F.lit("concept-"), "p_partkey").alias("slug"))


def edges(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    most = p.agg(F.max("k")).first()[0]

    def of(rows, target, relation):
        return rows.select(F.col("k").alias("source_id"), target.cast("long").alias("target_id"), F.lit(relation).alias("relation"), (0.5 + (F.col("k") % 50) / 100.0).alias("confidence"), (0.1 + (F.col("k") % 9) / 10.0).alias("weight"), (F.col("k") % 3 == 0).alias("verified"))

    out = of(p.where("k >= 2"), F.floor(F.col("k") / 2), "requires").unionByName(of(p.where("k >= 10"), F.floor(F.col("k") / 10), "part_of")).unionByName(of(p.where(F.col("k") + 7 <= most), F.col("k") + 7, "related_to"))
    return out.withColumn("source_id", F.col("source_id").cast("long"))


USAGE_SQL = """usage AS (SELECT CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'gpt-4o-mini' WHEN 'NF' THEN 'gpt-4.1' WHEN 'NO' THEN 'openai/gpt-4o' ELSE 'local-model' END AS model,
    (l_quantity * 100)::BIGINT AS prompt_tokens, (l_linenumber * 50)::BIGINT AS completion_tokens, l_tax > 0.06 AS fallback_used, l_linenumber AS task FROM lineitem)"""


def usage(spark, sf_dir: str) -> DataFrame:
    key = F.concat("l_returnflag", "l_linestatus")
    model = F.when(key == "AF", "gpt-4o-mini").when(key == "NF", "gpt-4.1").when(key == "NO", "openai/gpt-4o").otherwise("local-model")
    return table(spark, sf_dir, "lineitem").select(model.alias("model"), (F.col("l_quantity") * 100).cast("long").alias("prompt_tokens"), (F.col("l_linenumber") * 50).cast("long").alias("completion_tokens"), (F.col("l_tax") > 0.06).alias("fallback_used"), F.col("l_linenumber").alias("task"))


# Prices of a million tokens by part of the model's name; the first hit counts.
PRICES = (("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.00), ("gpt-4.1-mini", 0.40, 1.60), ("gpt-4.1", 2.00, 8.00), ("o4-mini", 1.10, 4.40), ("claude-3-5-haiku", 0.80, 4.00),
    ("claude-3-5-sonnet", 3.00, 15.00), ("claude-3-haiku", 0.25, 1.25), ("gemini-1.5-flash", 0.075, 0.30), ("gemini-1.5-pro", 1.25, 5.00), ("llama-3.3-70b", 0.59, 0.79))
PRICES_SQL = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{m}', {a}::DOUBLE, {b}::DOUBLE)" for i, (m, a, b) in enumerate(PRICES)) + ") v(ord, part, prompt_price, completion_price))"


def prices(spark) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PRICES)], "ord int, part string, prompt_price double, completion_price double")
