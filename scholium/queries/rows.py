"""Operators by rows of the given tables: writes, quotes, safety, evidence, assessment, plans, lookups, versions."""

from pyspark.sql import functions as F

from scholium.functions import canonical as K, safety as S, text as T
from scholium.operators import answers as A, evaluation as E, graph as G, learning as P, ranking as R, services as V
from scholium.operators.lexical import spread
from scholium.queries.domain import GRAPH, REC_SQL, _graph, _rec
from scholium.queries.retrieval import QRELS_SQL, RERANK_SQL, _lists
from scholium.queries.tables import PRICES_SQL, USAGE_SQL, prices, table, usage
from scholium.registry import ORACLE, query
from scholium.scope import TenantScope
from scholium.sources import files

# ---- reads and writes of one tenant ----------------------------------------------


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("tenant_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


def _large(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("id"))


@query("tenant_lookup", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def tenant_lookup(spark, d):
    return TenantScope("2-HIGH").get_many(_orders(spark, d), _large(spark, d)).select("id", "price")


@query("tenant_delete", "SELECT o_orderpriority AS tenant_id, o_orderkey AS id FROM orders WHERE NOT (o_orderpriority = '2-HIGH' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48))")
def tenant_delete(spark, d):
    return TenantScope("2-HIGH").without(_orders(spark, d), _large(spark, d)).select("tenant_id", "id")


@query("tenant_stamp", "SELECT '2-HIGH' AS tenant_id, o_orderkey AS id FROM orders")
def tenant_stamp(spark, d):
    return TenantScope("2-HIGH").stamped(_orders(spark, d)).select("tenant_id", "id")


@query("missing_seeds", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 <> 0)")
def missing_seeds(spark, d):
    """Every page is a seed, twice; two thirds are in the catalogue."""
    p = table(spark, d, "pages")
    return files.missing_seeds(p.where("page_id % 3 <> 0"), p.unionByName(p)).select("url")


@query("replaced_chunks", "SELECT source AS tenant_id, doc_id AS document_id, n_chars + (doc_id % 10 = 0)::INT AS n_chars FROM documents")
def replaced_chunks(spark, d):
    old = table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("document_id"), "n_chars")
    return files.replaced_chunks(old, old.where("document_id % 10 = 0").withColumn("n_chars", F.col("n_chars") + 1))


# ---- texts and safety --------------------------------------------------------------


@query("bounded_quotes", r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents), h AS (SELECT *, rtrim(substr(flat, 1, 240)) AS head FROM f), s AS (SELECT *, length(head) - length(regexp_extract(head, '([^.!?]*)$', 1)) AS stop FROM h)
  SELECT doc_id, CASE WHEN length(flat) <= 240 THEN flat WHEN stop >= 80 THEN trim(substr(head, 1, stop)) ELSE head || '...' END AS quote, CASE WHEN length(flat) <= 80 THEN flat ELSE rtrim(substr(flat, 1, 79)) || '…' END AS title FROM s""")
def bounded_quotes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.bounded_quote(F.col("text")).alias("quote"), T.title_of(F.col("text")).alias("title"))


@query("escalated_verdicts", """WITH v AS (SELECT event_id, round(least(value / 200, 1), 6) AS was, event_type = 'purchase' AND event_id % 10 >= 7 AS up FROM events), s AS (SELECT event_id, CASE WHEN up THEN greatest(was, 0.75) ELSE was END AS score FROM v)
  SELECT event_id, score, CASE WHEN score >= 0.75 THEN 'refuse' WHEN score >= 0.4 THEN 'sanitize' ELSE 'allow' END AS level FROM s""")
def escalated_verdicts(spark, d):
    rows = table(spark, d, "events").select("event_id", F.round(F.least(F.col("value") / 200, F.lit(1.0)), 6).alias("score"), F.when(F.col("event_type") == "purchase", "injection").otherwise("benign").alias("label"), (F.col("event_id") % 10 / 10).alias("confidence"))
    return S.escalated(rows).select("event_id", "score", "level")


@query("neutralised_texts", "SELECT conv_id, turn, role || text || ' ' AS clean FROM conversations")
def neutralised_texts(spark, d):
    """Every turn between template tokens, a reserved tag and a control character."""
    text = F.concat(F.lit("<|im_start|>"), "role", "text", F.lit("</untrusted_evidence>"), F.lit("\x07"), F.lit(" [INST]"))
    return table(spark, d, "conversations").select("conv_id", "turn", S.neutralised(text).alias("clean"))


@query("prompt_echo", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN rtrim(text) ELSE text END AS clean FROM conversations")
def prompt_echo(spark, d):
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(f" {S.PROMPT_MARKERS[0]} of graphs. "), "role")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", S.without_prompt_echo(text).alias("clean"))


@query("hidden_fields", "SELECT event_id, event_type AS kind, '[redacted]' AS secret, value FROM events")
def hidden_fields(spark, d):
    nested = table(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.array(F.struct(F.col("props").alias("secret"), "value")).alias("rows")).alias("body"))
    return S.without_fields(nested, {"secret"}).select("event_id", "body.kind", F.col("body.rows")[0]["secret"].alias("secret"), F.col("body.rows")[0]["value"].alias("value"))


@query("masked_arguments", "SELECT event_id, '[redacted]' AS api_key, '[redacted]' AS token, event_type AS query FROM events")
def masked_arguments(spark, d):
    given = F.create_map(F.lit("api_KEY"), F.coalesce("props", F.lit("")), F.lit("Access_Token"), F.col("user_id").cast("string"), F.lit("query"), F.col("event_type"))
    shown = table(spark, d, "events").select("event_id", S.masked(given).alias("m"))
    return shown.select("event_id", F.col("m")["api_KEY"].alias("api_key"), F.col("m")["Access_Token"].alias("token"), F.col("m")["query"].alias("query"))


@query("rendered_prompts", "SELECT conv_id, turn, role || ': {' || text || '} ' || role AS prompt FROM conversations")
def rendered_prompts(spark, d):
    """A text that looks like a template is put in as it is."""
    values = F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.rendered(F.lit("{role}: {{{text}}} {role}"), values).alias("prompt"))


# ---- evidence ------------------------------------------------------------------------


def _evidence(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("turn_id"), (e % 20).alias("chunk_id"), e.alias("seq"), F.when(e % 5 != 0, F.round("value", 0)).alias("rerank_score"), (e % 3 / 10).alias("rrf_score"))


EVIDENCE_SQL = "e AS (SELECT user_id AS turn_id, event_id % 20 AS chunk_id, event_id AS seq, CASE WHEN event_id % 5 <> 0 THEN round(value, 0) END AS rerank_score, (event_id % 3) / 10.0::DOUBLE AS rrf_score FROM events)"


@query("evidence_once", f"WITH {EVIDENCE_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY turn_id, chunk_id ORDER BY seq DESC) AS n, min(seq) OVER (PARTITION BY turn_id, chunk_id) AS place FROM e) SELECT turn_id, chunk_id, place AS seq, rerank_score, rrf_score FROM x WHERE n = 1")
def evidence_once(spark, d):
    return R.last_copy_first_place(_evidence(spark, d))


@query("evidence_order", f"WITH {EVIDENCE_SQL} SELECT turn_id, seq, row_number() OVER (PARTITION BY turn_id ORDER BY rerank_score DESC NULLS LAST, rrf_score DESC, seq) AS place FROM e")
def evidence_order(spark, d):
    return R.evidence_order(_evidence(spark, d)).select("turn_id", "seq", "place")


@query("evidence_rows", f"WITH {EVIDENCE_SQL} SELECT turn_id, chunk_id, 'S' || seq AS citation_id, seq FROM e")
def evidence_rows(spark, d):
    return A.evidence_rows(_evidence(spark, d).withColumnRenamed("seq", "final_rank")).select("turn_id", "chunk_id", "citation_id", "seq")


@query("used_citations", "SELECT a.conv_id AS query_id, a.turn, b.turn AS place, 'S' || (b.turn * 2 % 7) AS citation_id FROM (SELECT DISTINCT conv_id, turn FROM conversations) a JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND a.turn = b.turn * 2 % 7")
def used_citations(spark, d):
    """A conversation's answer names as many ids as it has turns, in an order of its own; a turn is a row of the context."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), "turn").distinct()
    said = turns.groupBy("query_id").agg(F.transform(F.sequence(F.lit(0), F.max("turn")), lambda t: F.concat(F.lit("S"), (t * 2 % 7).cast("string"))).alias("cited"))
    context = turns.select("query_id", F.concat(F.lit("S"), F.col("turn").cast("string")).alias("citation_id"), F.col("turn").alias("chunk_id"))
    found = A.used_citations(said, context).join(turns.withColumnRenamed("turn", "place"), ["query_id", "place"], "left_semi")
    return found.select("query_id", F.col("chunk_id").alias("turn"), "place", "citation_id")


@query("citation_set_metrics", """WITH a AS (SELECT l_orderkey AS answer_id, coalesce(list(DISTINCT l_linenumber) FILTER (l_tax > 0.04), []) AS cited, coalesce(list(DISTINCT l_linenumber) FILTER (l_discount > 0.05), []) AS relevant, coalesce(list(DISTINCT l_linenumber) FILTER (l_quantity > 10), []) AS available FROM lineitem GROUP BY ALL),
  h AS (SELECT *, len(list_intersect(cited, relevant)) AS hit, len(cited) - len(list_intersect(cited, available)) AS invented FROM a)
  SELECT answer_id, CASE WHEN len(cited) > 0 THEN hit / len(cited) ELSE 0 END AS precision, CASE WHEN len(relevant) > 0 THEN hit / len(relevant) ELSE 0 END AS recall, CASE WHEN len(cited) > 0 THEN invented / len(cited) ELSE 0 END AS hallucination_rate FROM h""")
def citation_set_metrics(spark, d):
    those = lambda c: F.collect_list(F.when(c, F.col("l_linenumber")))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id")).agg(those(F.col("l_tax") > 0.04).alias("cited"), those(F.col("l_discount") > 0.05).alias("relevant"), those(F.col("l_quantity") > 10).alias("available"))
    return E.citation_metrics(rows)


@query("judge_scores", "SELECT l_orderkey AS answer_id, CASE WHEN l_linenumber % 4 > 0 THEN (l_linenumber % 4 - (l_partkey % 2)) / (l_linenumber % 4) END AS faithfulness, (l_suppkey % 5) / 4.0::DOUBLE AS relevance, (l_partkey % 5) / 4.0::DOUBLE AS correctness FROM lineitem")
def judge_scores(spark, d):
    n = F.col("l_linenumber") % 4
    return E.judged(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), n.alias("n_statements"), (n - F.col("l_partkey") % 2).alias("n_supported"), (1 + F.col("l_suppkey") % 5).alias("relevance"), (1 + F.col("l_partkey") % 5).alias("correctness")))


@query("reranked_order", """WITH r AS (SELECT user_id AS query_id, event_id AS seq, event_id % 30 AS chunk_id, round(value, 2) AS rerank_score FROM events), f AS (SELECT query_id, chunk_id, min(seq) AS seq, arg_min(rerank_score, seq) AS rerank_score FROM r WHERE (query_id, chunk_id) IN (SELECT user_id, event_id % 30 FROM events WHERE event_type = 'purchase') GROUP BY ALL)
  SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS place FROM f""")
def reranked_order(spark, d):
    """What was bought are the candidates; what the reranker returns names others too, and some twice."""
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 30).alias("chunk_id"), F.round("value", 2).alias("rerank_score"), "event_type")
    return R.reordered(e.where("event_type = 'purchase'"), e)


@query("question_metrics", f"""{RERANK_SQL}, {QRELS_SQL}, need AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY ALL),
  final AS (SELECT query_id, chunk_id, rerank_rank AS rank FROM reranked WHERE rerank_rank <= 5), marked AS (SELECT f.query_id, f.rank, (q.chunk_id IS NOT NULL)::INT AS rel FROM final f LEFT JOIN qrels q USING (query_id, chunk_id)),
  run AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM marked),
  early AS (SELECT query_id, any_value(n) AS n, count(*) FILTER (list = 's' AND rank <= 20) AS s, count(*) FILTER (list = 'l' AND rank <= 20) AS l, count(*) FILTER (list = 'f' AND rank <= 10) AS f, min(rank) FILTER (list = 'f') AS first
    FROM need LEFT JOIN (SELECT query_id, list, rank FROM (SELECT query_id, chunk_id, rank, 's' AS list FROM semantic UNION ALL SELECT query_id, chunk_id, rank, 'l' FROM lexical UNION ALL SELECT query_id, chunk_id, final_rank, 'f' FROM fused) SEMI JOIN qrels USING (query_id, chunk_id)) USING (query_id) GROUP BY query_id),
  late AS (SELECT query_id, coalesce(sum(rel), 0) AS found, count(rel) AS k, min(CASE WHEN rel = 1 THEN rank END) AS first_hit, coalesce(sum(rel / log2(rank + 1)), 0) AS dcg, coalesce(sum(CASE WHEN rel = 1 THEN hits / rank END), 0) AS precisions FROM need LEFT JOIN run USING (query_id) GROUP BY query_id)
  SELECT query_id, round(s / n, 6) AS semantic_recall_at_20, round(l / n, 6) AS lexical_recall_at_20, round(f / n, 6) AS fused_recall_at_10, round(coalesce(1.0::DOUBLE / first, 0), 6) AS fused_mrr, round(CASE WHEN k > 0 THEN found / k ELSE 0 END, 6) AS precision_at_5, round(found / n, 6) AS recall_at_5, round(coalesce(1.0::DOUBLE / first_hit, 0), 6) AS mrr_at_5,
    round(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg_at_5, round(CASE WHEN found > 0 THEN precisions / found ELSE 0 END, 6) AS context_precision, round(found / n, 6) AS context_recall FROM early JOIN late USING (query_id)""")
def question_metrics(spark, d):
    """Ten metrics of every question that some document answers; the semantic list is a stand-in that SQL can state."""
    rows, asked, semantic, lexical = _lists(spark, d)
    fused = R.fuse(semantic, lexical).withColumnRenamed("final_rank", "rank")
    final = R.lexical_rerank(asked, fused, rows, 5).withColumnRenamed("rerank_rank", "rank")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return E.question_metrics(semantic, lexical, fused, final, E.holding(docs, asked.select("query_id", F.col("text").alias("item"))))


# ---- usage and versions --------------------------------------------------------------


@query("cost_sources", f"""WITH {USAGE_SQL}, {PRICES_SQL}, own AS (SELECT * FROM (VALUES ('local-model', 0.5::DOUBLE, 1.0::DOUBLE), ('gpt-4.1', 0.0, 0.0), ('openai/gpt-4o', 2.0, 9.0)) v(model, a, b)), m AS (SELECT model, (SELECT arg_min(struct_pack(a := prompt_price, b := completion_price), ord) FROM prices WHERE contains(lower(model), part)) AS p FROM (SELECT DISTINCT model FROM usage)),
  c AS (SELECT model, prompt_tokens / 1e6 * a + completion_tokens / 1e6 * b AS own_cost, prompt_tokens / 1e6 * p.a + completion_tokens / 1e6 * p.b AS list_cost FROM (SELECT model, CASE WHEN task % 4 = 3 THEN 0 ELSE prompt_tokens END AS prompt_tokens, completion_tokens FROM usage) LEFT JOIN own USING (model) LEFT JOIN m USING (model))
  SELECT model, CASE WHEN coalesce(own_cost, 0) > 0 THEN 'provider' WHEN list_cost IS NOT NULL THEN 'static' ELSE 'unknown' END AS source, count(*) AS calls, round(sum(CASE WHEN coalesce(own_cost, 0) > 0 THEN own_cost ELSE coalesce(list_cost, 0) END), 8) AS cost_usd FROM c GROUP BY ALL""")
def cost_sources(spark, d):
    own = spark.createDataFrame([("local-model", 0.5, 1.0), ("gpt-4.1", 0.0, 0.0), ("openai/gpt-4o", 2.0, 9.0)], "model string, prompt_price double, completion_price double")
    calls = usage(spark, d).withColumn("prompt_tokens", F.when(F.col("task") % 4 == 3, -F.col("prompt_tokens")).otherwise(F.col("prompt_tokens")))
    return E.cost_sources(calls, prices(spark), own).groupBy("model", "source").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 8).alias("cost_usd"))


@query("turn_usage", "SELECT l_orderkey AS turn_id, sum((l_quantity * 100)::BIGINT)::BIGINT AS prompt_tokens, sum(greatest(l_linenumber * 50 - 100, 0))::BIGINT AS completion_tokens, sum((l_quantity * 100)::BIGINT + l_linenumber * 50)::BIGINT AS total_tokens, round(sum(greatest(l_discount - 0.05, 0)), 6) AS cost_usd, count(*) AS calls FROM lineitem GROUP BY l_orderkey")
def turn_usage(spark, d):
    q, n = (F.col("l_quantity") * 100).cast("long"), F.col("l_linenumber").cast("long")
    return E.turn_usage(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("turn_id"), q.alias("prompt_tokens"), (n * 50 - 100).alias("completion_tokens"), (q + n * 50).alias("total_tokens"), (F.col("l_discount") - 0.05).alias("cost_usd")))


SETTINGS_SQL = """s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_discount / 7 AS a, -l_tax / 1e6 AS b, l_extendedprice * 1e12 AS c, l_tax > 0.04 AS t FROM lineitem)"""


@query("config_versions", f"""WITH {SETTINGS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, substr(sha256(l_partkey || ':' || l_suppkey || ':' || l_linenumber), 1, 12) AS chunking,
    substr(sha256('{{"bm25_b":' || a || ',"bm25_k1":' || q || ',"context_token_budget":' || l_partkey || ',"embedding_dim":' || l_linenumber || ',"embedding_model":"m\\u00e9' || l_suppkey || '","embedding_provider":"p\\"' || l_linenumber || '","hnsw_ef_search":' || l_suppkey || ',"metadata_filtering_enabled":' || t || ',"rerank_enabled":' || (NOT t) || ',"rerank_min_score":' || b || ',"rerank_top_k":5,"reranker_model":null,"retrieval_top_k_per_retriever":20,"rrf_k":60}}'), 1, 12) AS retrieval,
    substr(sha256('{{"auto_accept":' || a || ',"cross_course":' || t || ',"llm_confidence_cap":' || c || ',"max_chunks":' || l_suppkey || ',"max_edges_per_chunk":' || l_linenumber || ',"max_edges_per_document":' || l_partkey || ',"model":"m","prompt_version":"v1","review_floor":' || b || ',"weights":{{"agreement":' || a || ',"base":' || q || ',"corroboration":' || b || ',"cue":' || c || ',"llm":0.25}}}}'), 1, 12) AS extraction FROM s""")
def config_versions(spark, d):
    """The three versions of settings that a line stands for; numbers from 1e-8 to 1e17, texts with quotes and accents."""
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    q, a, b, c, t = F.col("l_quantity"), F.col("l_discount") / 7, -F.col("l_tax") / 1e6, F.col("l_extendedprice") * 1e12, F.col("l_tax") > 0.04
    values = {
        "max_tokens": p, "overlap_tokens": s, "min_tokens": n, "embedding_provider": F.concat(F.lit('p"'), n.cast("string")), "embedding_model": F.concat(F.lit("mé"), s.cast("string")), "embedding_dim": n, "retrieval_top_k_per_retriever": F.lit(20), "rrf_k": F.lit(60), "bm25_k1": q, "bm25_b": a,
        "hnsw_ef_search": s, "rerank_enabled": ~t, "reranker_model": F.lit(None).cast("string"), "rerank_top_k": F.lit(5), "rerank_min_score": b, "context_token_budget": p, "metadata_filtering_enabled": t, "model": F.lit("m"), "prompt_version": F.lit("v1"), "max_chunks": s, "max_edges_per_chunk": n, "max_edges_per_document": p, "cross_course": t,
        "weights": F.struct(q.alias("base"), F.lit(0.25).alias("llm"), b.alias("corroboration"), c.alias("cue"), a.alias("agreement")), "llm_confidence_cap": c, "auto_accept": a, "review_floor": b}
    rows = spread(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", *(v.alias(k) for k, v in values.items()))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", K.chunking_version().alias("chunking"), K.settings_version(rows, K.RETRIEVAL).alias("retrieval"), K.settings_version(rows, K.EXTRACTION).alias("extraction"))


@query("document_versions")
def document_versions(spark, d):
    """A version of every whole row of ``documents``; held against the standard library's JSON."""
    rows = table(spark, d, "documents")
    return rows.select("doc_id", K.version(K.canonical(F.struct("*"), rows.schema)).alias("version"))


# ---- graph -----------------------------------------------------------------------------


@query("direct_evidence", f"""{GRAPH}, x AS (SELECT source_id, target_id, relation, CASE WHEN source_id % 4 <> 0 THEN source_id END AS document_id, row_number() OVER (PARTITION BY source_id, relation ORDER BY e.verified DESC, weight DESC, difficulty, slug) AS rank FROM edges e JOIN concepts c ON c.concept_id = target_id WHERE confidence >= 0.6)
  SELECT source_id, target_id, relation, rank, source || '/' || doc_id AS title FROM x LEFT JOIN documents ON doc_id = document_id WHERE rank <= 50""")
def direct_evidence(spark, d):
    """Neighbours by each relation, with the title of the document that an edge names."""
    seeds, e, c = _graph(spark, d)
    e = e.withColumn("document_id", F.when(F.col("source_id") % 4 != 0, F.col("source_id")))
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("title"))
    each = [G.direct(seeds, e, c, r, min_confidence=0.6, documents=titles) for r in ("requires", "part_of", "related_to")]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("source_id", "target_id", "relation", "rank", "title")


@query("search_one_hop", f"""{GRAPH}, e AS (SELECT source_id, target_id, CASE WHEN relation = 'related_to' AND source_id % 2 = 0 THEN 'used_in' ELSE relation END AS relation, confidence, weight, verified FROM edges WHERE confidence >= 0.6),
  used AS (SELECT source_id AS seed, target_id AS concept_id, slug, 'used_in' AS direction, row_number() OVER (PARTITION BY source_id ORDER BY e.verified DESC, weight DESC, difficulty, slug) AS rank FROM e JOIN concepts c ON c.concept_id = target_id WHERE relation = 'used_in'),
  near AS (SELECT DISTINCT seed, concept_id, 'related' AS kind FROM (SELECT source_id AS seed, target_id AS concept_id FROM e WHERE relation = 'related_to' UNION ALL SELECT target_id, source_id FROM e WHERE relation = 'related_to')),
  sib AS (SELECT DISTINCT a.source_id AS seed, b.source_id AS concept_id, 'sibling' AS kind FROM e a JOIN e b ON b.target_id = a.target_id AND a.relation = 'part_of' AND b.relation = 'part_of' WHERE b.source_id <> a.source_id),
  cut AS (SELECT * FROM (SELECT u.*, difficulty, slug, row_number() OVER (PARTITION BY seed, kind ORDER BY difficulty, slug) AS n FROM (SELECT * FROM near UNION ALL SELECT * FROM sib) u JOIN concepts USING (concept_id) WHERE concept_id <> seed) WHERE n <= 10),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, concept_id ORDER BY kind) AS m FROM cut) WHERE m = 1)
  SELECT seed, concept_id, 1 AS depth, direction, rank FROM used WHERE rank <= 10 UNION ALL SELECT seed, concept_id, 1, 'related_to', rank FROM (SELECT seed, concept_id, row_number() OVER (PARTITION BY seed ORDER BY difficulty, slug) AS rank FROM once) WHERE rank <= 10""")
def search_one_hop(spark, d):
    """Searches by two relations that are not transitive."""
    seeds, e, c = _graph(spark, d)
    e = e.withColumn("relation", F.when((F.col("relation") == "related_to") & (F.col("source_id") % 2 == 0), "used_in").otherwise(F.col("relation")))
    found = G.search(seeds, e, c, k=10, relation="used_in").unionByName(G.search(seeds, e, c, k=10, relation="related_to"))
    return found.select("seed", "concept_id", "depth", "direction", "rank")


# ---- learners, plans, assessment ---------------------------------------------------------


@query("unpersonalised", f"{REC_SQL}, r AS (SELECT resource_id, row_number() OVER (ORDER BY CASE trust WHEN 'official' THEN 1.0 WHEN 'academic' THEN 0.8 WHEN 'community' THEN 0.5 ELSE 0.25 END DESC, 'Page ' || resource_id % 9, url) AS rank FROM res) SELECT user_id, resource_id, false AS personalised, rank FROM (SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM gaps)) JOIN r ON rank <= 10")
def unpersonalised(spark, d):
    """Customers without gaps get the catalogue's order."""
    resources, _, gaps = _rec(spark, d)
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(gaps, "user_id", "left_anti")
    return P.unpersonalised(resources.withColumn("title", F.concat(F.lit("Page "), (F.col("resource_id") % 9).cast("string"))), users)


@query("gap_explanations", f"""{REC_SQL}, r AS ({ORACLE['recommend_rank']}), g AS (SELECT user_id, resource_id, list(slug ORDER BY mastery, -(1 + substr(slug, 9)::INT % 5), slug) AS l FROM r JOIN cov USING (resource_id) JOIN gaps USING (user_id, slug) GROUP BY ALL)
  SELECT user_id, resource_id, 'Covers ' || l[1] || CASE WHEN len(l) > 1 THEN ', then ' || l[2] ELSE '' END AS explanation FROM r LEFT JOIN g USING (user_id, resource_id)""")
def gap_explanations(spark, d):
    resources, covers, gaps = _rec(spark, d)
    hard = gaps.withColumn("difficulty", 1 + F.substring("slug", 9, 9).cast("int") % 5)
    return P.explained(P.recommend(resources, covers, gaps), covers, hard).select("user_id", "resource_id", "explanation")


@query("merged_gaps", """WITH e AS (SELECT DISTINCT user_id, event_id % 4 AS part, 'concept-' || (event_id % 40) AS slug, (event_id % 40) / 100.0::DOUBLE AS mastery, 1 + event_id % 5 AS difficulty FROM events),
  s AS (SELECT *, CASE WHEN part = 0 AND user_id % 3 = 0 THEN 0 WHEN part = 1 AND user_id % 3 <> 2 THEN 1 WHEN part = 2 THEN 2 END AS source FROM e), f AS (SELECT * FROM s WHERE source IS NOT NULL QUALIFY source = min(source) OVER (PARTITION BY user_id))
  SELECT user_id, slug, source::INT AS source, row_number() OVER (PARTITION BY user_id ORDER BY mastery, difficulty DESC, slug) AS place FROM f""")
def merged_gaps(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select("user_id", (e % 4).alias("part"), F.concat(F.lit("concept-"), (e % 40).cast("string")).alias("slug"), (e % 40 / 100).alias("mastery"), (1 + e % 5).alias("difficulty"))
    return P.merged_gaps(rows.where("part = 0 and user_id % 3 = 0"), rows.where("part = 1 and user_id % 3 <> 2"), rows.where("part = 2")).select("user_id", "slug", "source", "place")


@query("rubric_sets", "SELECT l_orderkey AS item_id, (count(*) = count(DISTINCT l_linenumber) AND count(DISTINCT l_linenumber) = max(l_linenumber)) AS valid FROM lineitem GROUP BY l_orderkey")
def rubric_sets(spark, d):
    """The lines of an order as criteria, of which each number from 1 to the largest is expected once."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_list("l_linenumber").alias("given"), F.max("l_linenumber").alias("most"))
    return rows.select("item_id", P.rubric_valid(F.col("given"), F.sequence(F.lit(1), F.col("most"))).alias("valid"))


@query("grounded_misconceptions", "SELECT l_orderkey AS item_id, count(*) FILTER (l_partkey % 7 = l_orderkey % 7 OR l_suppkey % 7 = l_orderkey % 7) AS n FROM lineitem GROUP BY l_orderkey")
def grounded_misconceptions(spark, d):
    made = F.collect_list(F.struct("l_linenumber", F.array(F.col("l_partkey") % 7, F.col("l_suppkey") % 7).alias("citations")))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(made.alias("made"))
    return rows.select("item_id", F.size(P.grounded(F.col("made"), F.array(F.col("item_id") % 7))).cast("long").alias("n"))


@query("quiz_gates", """WITH g AS (SELECT conv_id AS quiz_id, turn AS item_no, CASE WHEN turn % 5 = 0 THEN 'empty_stem' WHEN turn % 5 = 1 THEN 'too_few_options' WHEN turn % 5 = 2 THEN 'repeated_options' WHEN turn % 7 = 3 THEN 'bad_key' WHEN conv_id % 4 = 0 THEN 'no_citation' END AS gate FROM conversations),
  n AS (SELECT *, CASE WHEN gate IS NULL THEN row_number() OVER (PARTITION BY quiz_id, gate IS NULL ORDER BY item_no) END AS number FROM g) SELECT quiz_id, item_no, gate, number FROM n WHERE gate IS NOT NULL OR number <= 1""")
def quiz_gates(spark, d):
    k = F.col("turn") % 5
    options = F.when(k == 1, F.array(F.lit("a"))).when(k == 2, F.array(*map(F.lit, "aba"))).otherwise(F.array(*map(F.lit, "abc")))
    items = table(spark, d, "conversations").select(F.col("conv_id").alias("quiz_id"), F.col("turn").alias("item_no"), F.when(k == 0, "  ").otherwise(F.concat(F.lit("What? "), "text")).alias("stem"), options.alias("options"), F.when(F.col("turn") % 7 == 3, 9).otherwise(1).alias("correct"), F.when(F.col("conv_id") % 4 != 0, F.array(F.lit("S1"))).otherwise(F.array().cast("array<string>")).alias("citations"))
    return P.quiz_items(items, 1).select("quiz_id", "item_no", "gate", "number")


@query("step_states", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'available' WHEN l_tax > 0.05 THEN 'blocked' ELSE 'pending' END AS status FROM lineitem")
def step_states(spark, d):
    blocked = F.when(F.col("l_tax") > 0.05, F.array("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.step_status(F.col("l_linenumber") - 1, blocked).alias("status"))


@query("unblocked_steps", "SELECT p_partkey % 10 AS plan_id, p_partkey AS concept_id, CASE WHEN p_partkey % 3 = 0 THEN 'completed' WHEN p_partkey <= 10 OR (p_partkey - 10) % 3 = 0 THEN 'available' ELSE 'blocked' END AS status, (p_partkey > 10 AND (p_partkey - 10) % 3 <> 0)::INT AS n_blockers FROM part")
def unblocked_steps(spark, d):
    """Ten plans of which each step waits for the one before; every third concept is done."""
    k = F.col("p_partkey")
    steps = table(spark, d, "part").select((k % 10).alias("plan_id"), k.alias("concept_id"), F.when(k > 10, F.array(k - 10)).otherwise(F.array().cast("array<bigint>")).alias("blocked_by"), F.when(k > 10, "blocked").otherwise("available").alias("status"))
    return P.unblocked(steps, steps.where("concept_id % 3 = 0").select("plan_id", "concept_id")).select("plan_id", "concept_id", "status", F.size("blocked_by").alias("n_blockers"))


@query("step_transitions", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 AND l_tax > 0.05 THEN 'blocked' WHEN l_returnflag = 'R' AND l_linenumber % 3 <> 2 THEN 'invalid' END AS refusal FROM lineitem")
def step_transitions(spark, d):
    n = F.col("l_linenumber") % 3
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "completed").otherwise("pending").alias("status"), F.when(F.col("l_tax") > 0.05, F.array("l_partkey")).otherwise(F.array().cast("array<bigint>")).alias("blocked_by"), F.when(n == 0, "skipped").when(n == 1, "in_progress").otherwise("completed").alias("wanted"))
    return P.transition(rows).select("l_orderkey", "l_linenumber", "refusal")


@query("raised_floors", "SELECT event_id, greatest(coalesce(CASE WHEN event_id % 4 <> 0 THEN value / 200 END, 0.6), 0.6) AS floor FROM events")
def raised_floors(spark, d):
    return table(spark, d, "events").select("event_id", V.raised_floor(F.when(F.col("event_id") % 4 != 0, F.col("value") / 200), 0.6).alias("floor"))


@query("narrowed_progress", "SELECT user_id, CASE WHEN user_id % 5 = 0 THEN count(DISTINCT event_id % 40) ELSE count(DISTINCT event_id % 40) FILTER (event_id % 40 IN (1, 2, user_id % 40)) END AS n FROM events GROUP BY user_id")
def narrowed_progress(spark, d):
    e = (F.col("event_id") % 40).cast("string")
    by = table(spark, d, "events").groupBy("user_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(e.alias("key"), e.alias("value"))))).alias("m"))
    wanted = F.when(F.col("user_id") % 5 != 0, F.array(F.lit("1"), F.lit("2"), (F.col("user_id") % 40).cast("string")))
    return V.narrowed(by, "m", wanted).select("user_id", F.size("m").cast("long").alias("n"))
