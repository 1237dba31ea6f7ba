"""Scans, text analysis, BM25, vectors, fusion and their evaluation."""

import uuid

from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import ann as N, evaluation as E, hybrid as H, index as I, lexical as L, ranking as R, vector as V
from scholium.queries.tables import BM25_SQL, CHUNKS_SQL, QUESTIONS_SQL, RETRIEVAL_SQL, STATS_SQL, STOP_SQL, TERMS_SQL, chunks, questions, table, tokens_sql
from scholium.registry import query
from scholium.scope import TenantScope
from scholium.sources import files
from scholium.store import shared_folder


@query("tenant_scan", "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def tenant_scan(spark, d):
    return TenantScope("src3").rows(table(spark, d, "documents"), "source").select("doc_id", "lang", "n_chars")


@query("no_tenant_no_rows", "SELECT doc_id FROM documents WHERE false")
def no_tenant_no_rows(spark, d):
    return TenantScope(None).rows(table(spark, d, "documents"), "source").select("doc_id")


@query("source_type_semi_join", "SELECT l.doc_id, l.quality FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang IN ('fr', 'de'))")
def source_type_semi_join(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").where(F.col("lang").isin("fr", "de")), "doc_id", "left_semi").select("doc_id", "quality")


@query("docs_newest_page", "SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 20 OFFSET 20")
def docs_newest_page(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), F.desc("doc_id")).offset(20).limit(20).drop("n_chars")


@query("dedup_by_hash", "SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY source, lang, sha256(text) ORDER BY doc_id) > 1 AS reused FROM documents")
def dedup_by_hash(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("lang").alias("course_id"), F.col("doc_id").alias("document_id"), "text")
    return files.first_copies(rows).select(F.col("document_id").alias("doc_id"), "sha256", "reused")


@query("chunk_count", "SELECT source AS tenant_id, count(*) AS n FROM documents GROUP BY source")
def chunk_count(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("tenant_id")).agg(F.count(F.lit(1)).alias("n"))


@query("chat_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 4")
def chat_history(spark, d):
    rows = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return L.top_k(rows, ["conv_id"], [F.desc("turn")], 4, "n").select("conv_id", "turn", "role")


@query("catalogue_search", r"SELECT page_id, url, count(*) OVER () AS total FROM pages WHERE url ILIKE '%1%' OR html ILIKE '%nav%' ORDER BY url, page_id LIMIT 25")
def catalogue_search(spark, d):
    rows = table(spark, d, "pages").where(F.lower("url").contains("1") | F.lower("html").contains("nav"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.select("page_id", "url").orderBy("url", "page_id").limit(25).join(F.broadcast(total))


@query("corpus_hash", "SELECT sha256(string_agg(doc_id::VARCHAR || chr(0) || coalesce(text, '') || chr(0), '' ORDER BY doc_id::VARCHAR)) AS corpus_hash FROM documents")
def corpus_hash(spark, d):
    return files.corpus_hash(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("filename"), "text"))


@query("corpus_hash_all")
def corpus_hash_all(spark, d):
    """Over every document, by ranges of names, so that no task sees all of them."""
    return files.ranged_corpus_hash(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("filename"), "text"))


@query("tokenize_terms", f"WITH {CHUNKS_SQL}, {TERMS_SQL} SELECT chunk_id, term, tf FROM terms")
def tokenize_terms(spark, d):
    return L.chunk_terms(chunks(spark, d)).select("chunk_id", "term", "tf")


@query("doc_freq", f"WITH {CHUNKS_SQL}, {TERMS_SQL}, {STATS_SQL} SELECT * FROM df")
def doc_freq(spark, d):
    return L.doc_freq(L.chunk_terms(chunks(spark, d)))


@query("doc_freq_incremental", f"WITH {CHUNKS_SQL}, {TERMS_SQL} SELECT tenant_id, term, count(*) AS doc_freq FROM terms WHERE chunk_id % 10 <> 0 GROUP BY ALL")
def doc_freq_incremental(spark, d):
    """The statistics after every tenth chunk was deleted, from those before and the terms affected."""
    terms = L.chunk_words(L.indexed(chunks(spark, d)))
    return L.updated_doc_freq(L.doc_freq(terms), terms.where("chunk_id % 10 <> 0"), terms.where("chunk_id % 10 = 0"))


@query("corpus_stats", f"WITH {CHUNKS_SQL}, {TERMS_SQL}, {STATS_SQL} SELECT tenant_id, doc_count, total_tokens, round(avg_doc_len, 6) AS avg_doc_len FROM corpus")
def corpus_stats(spark, d):
    return L.corpus_stats(chunks(spark, d)).withColumn("avg_doc_len", F.round("avg_doc_len", 6))


@query("idf_table", f"WITH {CHUNKS_SQL}, {TERMS_SQL}, {STATS_SQL} SELECT tenant_id, term, round(ln(1 + (doc_count - doc_freq + 0.5) / (doc_freq + 0.5)), 6) AS idf FROM df JOIN corpus USING (tenant_id)")
def idf_table(spark, d):
    rows = L.indexed(chunks(spark, d))
    return L.doc_freq(L.chunk_words(rows)).join(L.corpus_stats(rows), "tenant_id").select("tenant_id", "term", F.round(L.idf(F.col("doc_count"), F.col("doc_freq")), 6).alias("idf"))


@query("bm25_topk", f"{RETRIEVAL_SQL} SELECT query_id, tenant_id, chunk_id, score, rank FROM lexical")
def bm25_topk(spark, d):
    return L.bm25(questions(spark, d), L.indexed(chunks(spark, d)))


def _index(spark, d):
    index = I.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.put(chunks(spark, d).withColumn("document_id", F.col("chunk_id")))
    return index


@query("bm25_index", f"{RETRIEVAL_SQL} SELECT query_id, tenant_id, chunk_id, score, rank FROM lexical")
def bm25_index(spark, d):
    """The ranking of ``bm25_topk`` out of a stored index."""
    return _index(spark, d).bm25(questions(spark, d))


@query("bm25_reingest", RETRIEVAL_SQL.replace("FROM documents", "FROM (SELECT doc_id, source, lang, CASE doc_id % 10 WHEN 0 THEN reverse(lower(text)) || ' reingested' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 5)") + " SELECT query_id, tenant_id, chunk_id, score, rank FROM lexical")
def bm25_reingest(spark, d):
    """The ranking after a tenth of the documents came again with other texts and another tenth went."""
    index = _index(spark, d)
    rows = table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.concat(F.reverse(F.lower("text")), F.lit(" reingested")).alias("text"))
    index.put(L.analysed(rows.where("document_id % 10 = 0")), rows.where("document_id % 10 in (0, 5)"))
    return index.bm25(questions(spark, d))


@query("empty_query_degraded", "SELECT query_id, CASE WHEN query_id = 1 THEN ['empty_query_terms'] WHEN query_id = 2 THEN ['no_corpus_stats'] WHEN query_id = 3 THEN ['empty_query_terms', 'no_corpus_stats'] ELSE []::VARCHAR[] END AS degraded FROM (VALUES (0), (1), (2), (3)) v(query_id)")
def empty_query_degraded(spark, d):
    asked = spark.createDataFrame([(0, "src1", "gradient descent"), (1, "src1", "the and of"), (2, "nobody", "gradient"), (3, "nobody", "the")], "query_id int, tenant_id string, text string")
    return L.degradations(asked, L.corpus_stats(chunks(spark, d)))


DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
COSINE = f"SELECT q.vec_id AS query_id, b.vec_id, round({DOT.replace('a.', 'q.')} / ({NORM.replace('a.', 'q.')}), 6) AS score FROM embeddings q JOIN embeddings b ON %s WHERE q.vec_id %% 100 = 0"
SEMANTIC = "SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (%s)) WHERE rank <= 20"


@query("cosine_topk", SEMANTIC % (COSINE % "true"))
def cosine_topk(spark, d):
    vectors = V.checked(table(spark, d, "embeddings"), 64)
    return V.cosine_top_k(vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), vectors)


@query("cosine_topk_tenant", SEMANTIC % (COSINE % "q.label = b.label"))
def cosine_topk_tenant(spark, d):
    vectors = table(spark, d, "embeddings").withColumnRenamed("label", "tenant_id")
    return V.cosine_top_k(vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "tenant_id"), vectors, by_tenant=True)


@query("ann_topk")
def ann_topk(spark, d):
    """The approximate search for the questions of ``cosine_topk``; held against it by recall."""
    vectors = V.checked(table(spark, d, "embeddings"), 64)
    return N.fitted(vectors).search(vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query("ann_topk_tenant")
def ann_topk_tenant(spark, d):
    """The same within the question's tenant."""
    vectors = table(spark, d, "embeddings").withColumnRenamed("label", "tenant_id")
    return N.fitted(vectors, by_tenant=True).search(vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "tenant_id"))


@query("hash_embed")
def hash_embed(spark, d):
    rows = chunks(spark, d).select("chunk_id", V.hash_embedding(64)(F.col("tokens")).alias("embedding"))
    return rows.select("chunk_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"), F.round(F.element_at("embedding", 1), 6).alias("first"))


def _lists(spark, d):
    """Two rank lists of the same questions: BM25, and document length as a stand-in for a semantic list."""
    rows = L.indexed(chunks(spark, d))
    asked = questions(spark, d)
    lexical = L.bm25(asked, rows)
    longest = L.top_k(rows, ["tenant_id"], [F.desc("token_count"), F.asc("chunk_id")], 20).select("tenant_id", "chunk_id", "rank")
    return rows, asked, longest.join(asked.select("query_id", "tenant_id"), "tenant_id"), lexical


LISTS_SQL = f"""{RETRIEVAL_SQL}, semantic AS (SELECT query_id, chunk_id, rank FROM (SELECT tenant_id, chunk_id, row_number() OVER (PARTITION BY tenant_id ORDER BY token_count DESC, chunk_id) AS rank FROM chunks) JOIN questions USING (tenant_id) WHERE rank <= 20),
  fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, least(semantic_rank, lexical_rank), chunk_id) AS final_rank FROM (
    SELECT query_id, chunk_id, s.rank AS semantic_rank, l.rank AS lexical_rank, CASE WHEN l.rank IS NULL OR s.rank <= l.rank THEN 'semantic' ELSE 'lexical' END AS source,
      round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0), 9) AS rrf_score FROM semantic s FULL JOIN lexical l USING (query_id, chunk_id))) WHERE final_rank <= 20)"""


@query("rrf_fuse", f"{LISTS_SQL} SELECT * FROM fused")
def rrf_fuse(spark, d):
    _, _, semantic, lexical = _lists(spark, d)
    return R.fuse(semantic, lexical)


@query("rrf_scores", f"{LISTS_SQL} SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM (SELECT query_id, chunk_id, rank FROM semantic UNION ALL SELECT query_id, chunk_id, rank FROM lexical) GROUP BY ALL")
def rrf_scores(spark, d):
    _, _, semantic, lexical = _lists(spark, d)
    cols = ["query_id", "retriever", "chunk_id", "rank"]
    rows = semantic.withColumn("retriever", F.lit("semantic")).select(cols).unionByName(lexical.withColumn("retriever", F.lit("lexical")).select(cols))
    return R.rrf(rows).withColumn("score", F.round("score", 9))


RERANK_SQL = f"""{LISTS_SQL}, reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rerank_rank FROM (
    SELECT query_id, chunk_id, round(len(list_filter(c.tokens, lambda x: list_contains(q.asked, x))) / sqrt(len(c.tokens)), 6) AS rerank_score
    FROM fused JOIN chunks c USING (chunk_id) JOIN (SELECT query_id, list_distinct({tokens_sql('text')}) AS asked FROM questions) q USING (query_id))) WHERE rerank_rank <= 20)"""


@query("lexical_rerank", f"{RERANK_SQL} SELECT * FROM reranked")
def lexical_rerank(spark, d):
    rows, asked, semantic, lexical = _lists(spark, d)
    return R.lexical_rerank(asked, R.fuse(semantic, lexical), rows, 20)


@query("rerank_floor", f"{RERANK_SQL} SELECT query_id, chunk_id, rerank_score, rerank_rank, CASE WHEN best < 6.0 THEN 'rerank_floor_removed_all' END AS degraded FROM (SELECT *, max(rerank_score) OVER (PARTITION BY query_id) AS best FROM reranked) WHERE rerank_score >= 6.0 OR (best < 6.0 AND rerank_rank = 1)")
def rerank_floor(spark, d):
    rows, asked, semantic, lexical = _lists(spark, d)
    return R.floored(R.lexical_rerank(asked, R.fuse(semantic, lexical), rows, 20), 6.0)


@query("hybrid_topk", f"{RERANK_SQL} SELECT query_id, chunk_id, rerank_rank AS place, semantic_rank, lexical_rank FROM reranked JOIN fused USING (query_id, chunk_id) WHERE rerank_rank <= 5")
def hybrid_topk(spark, d):
    rows, asked, semantic, lexical = _lists(spark, d)
    return R.rank_pipeline(asked, semantic, lexical, rows).select("query_id", "chunk_id", "place", "semantic_rank", "lexical_rank")


@query("hybrid_documents")
def hybrid_documents(spark, d):
    """Both retrievers on every question: cosine over hashed tokens within the tenant, and BM25; fused, reranked and cut."""
    rows = L.indexed(chunks(spark, d))
    asked = questions(spark, d)
    embed = V.hash_embedding()
    vectors = rows.select("tenant_id", F.col("chunk_id").alias("vec_id"), embed(F.col("tokens")).alias("embedding"))
    semantic = V.cosine_top_k(asked.select("query_id", "tenant_id", embed(T.tokenize(F.col("text"))).alias("embedding")), vectors, by_tenant=True)
    found = R.rank_pipeline(asked, semantic.withColumnRenamed("vec_id", "chunk_id"), L.bm25(asked, rows), rows)
    return found.select("query_id", "chunk_id", "place", "semantic_rank", "lexical_rank")


HALF_SQL = f"""WITH {CHUNKS_SQL}, {TERMS_SQL}, {STATS_SQL}, asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 6 = 1 THEN 'nobody' ELSE 'src' || (item_id % 20) END AS tenant_id, CASE WHEN item_id % 11 = 4 THEN 'the and of' ELSE text END AS text,
    CASE WHEN item_id % 5 = 0 THEN 'other' ELSE 'hashing' END AS model, item_id % 7 <> 3 AS embedded FROM benchmark),
  terms_asked AS (SELECT query_id, tenant_id, term FROM (SELECT query_id, tenant_id, unnest({tokens_sql('text')}) AS term FROM asked) WHERE term NOT IN ({STOP_SQL})),
  lexical AS (SELECT query_id, least(count(DISTINCT chunk_id), 20) AS n_lexical FROM terms_asked JOIN terms USING (tenant_id, term) GROUP BY query_id),
  reasons AS (SELECT query_id, (tenant_id = 'nobody' OR model = 'other' OR NOT embedded) AS no_semantic, CASE WHEN query_id NOT IN (SELECT query_id FROM terms_asked) THEN 'empty_query_terms' WHEN tenant_id = 'nobody' THEN 'no_corpus_stats' END AS no_lexical, tenant_id FROM asked)"""


def half_answered(spark, d):
    """Questions of which some have no vector, one of another model, no terms, or a tenant without a corpus."""
    i = F.col("item_id")
    rows = L.indexed(chunks(spark, d).withColumn("document_id", F.col("chunk_id")), "document_id")
    embed = V.hash_embedding(64)
    asked = table(spark, d, "benchmark").select(
        i.alias("query_id"), F.when(i % 6 == 1, "nobody").otherwise(F.concat(F.lit("src"), (i % 20).cast("string"))).alias("tenant_id"), F.when(i % 11 == 4, "the and of").otherwise(F.col("text")).alias("text"),
        F.when(i % 5 == 0, "other").otherwise("hashing").alias("model"), F.when(i % 7 != 3, embed(T.tokenize(F.col("text")))).alias("embedding"))
    index = I.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.put(rows)
    vectors = rows.select("tenant_id", "chunk_id", F.lit("hashing").alias("model"), embed(F.col("tokens")).alias("embedding"))
    return H.hybrid(asked, H.semantic_side(asked, vectors), H.lexical_side(asked, index), rows)


@query("hybrid_states", f"{HALF_SQL} SELECT query_id, list_sort(list_filter([CASE WHEN no_semantic THEN 'semantic_unavailable' END, no_lexical], lambda x: x IS NOT NULL)) AS degraded, coalesce(n_lexical, 0) AS n_lexical FROM reasons LEFT JOIN lexical USING (query_id)")
def hybrid_states(spark, d):
    """Why a side of a question has no list, as it comes out of the search."""
    return half_answered(spark, d).states.select("query_id", "degraded", "n_lexical")


@query("hybrid_half")
def hybrid_half(spark, d):
    """What is found where a side may be absent; hashed vectors have no SQL."""
    return half_answered(spark, d).ranked.select("query_id", "chunk_id", "place", "semantic_rank", "lexical_rank")


@query("multi_query_merge", f"{LISTS_SQL} SELECT turn_id, chunk_id, query_no, rank, row_number() OVER (PARTITION BY turn_id ORDER BY query_no, rank) AS position FROM (SELECT query_id % 5 AS turn_id, chunk_id, query_id // 5 AS query_no, rank, row_number() OVER (PARTITION BY query_id % 5, chunk_id ORDER BY query_id // 5, rank) AS n FROM lexical) WHERE n = 1")
def multi_query_merge(spark, d):
    rows = L.bm25(questions(spark, d), L.indexed(chunks(spark, d)))
    return R.multi_query(rows.select((F.col("query_id") % 5).alias("turn_id"), "chunk_id", F.floor(F.col("query_id") / 5).alias("query_no"), "rank"))


@query("retrieval_mode", f"{LISTS_SQL}, n AS (SELECT query_id, (SELECT count(*) FROM semantic s WHERE s.query_id = q.query_id AND q.query_id % 3 <> 0) AS n_semantic, (SELECT count(*) FROM lexical l WHERE l.query_id = q.query_id AND q.query_id % 4 <> 0) AS n_lexical, q.query_id % 2 AS n_reranked FROM questions q) SELECT query_id, CASE WHEN n_semantic = 0 AND n_lexical = 0 THEN 'retrieval_empty' WHEN n_semantic = 0 THEN 'lexical_only' WHEN n_lexical = 0 THEN 'semantic_only' WHEN n_reranked = 0 THEN 'reranker_unavailable' END AS mode FROM n")
def retrieval_mode(spark, d):
    _, asked, semantic, lexical = _lists(spark, d)
    s = semantic.where("query_id % 3 <> 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_semantic"))
    x = lexical.where("query_id % 4 <> 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_lexical"))
    sizes = asked.select("query_id", (F.col("query_id") % 2).alias("n_reranked")).join(s, "query_id", "left").join(x, "query_id", "left").fillna(0)
    return R.retrieval_mode(sizes).select("query_id", "mode")


# Every document competes, ranked by BM25 as one tenant.
ALL_SQL = RETRIEVAL_SQL.replace("source AS tenant_id", "'all' AS tenant_id").replace("'src' || (item_id % 20) AS tenant_id", "'all' AS tenant_id")
QRELS_SQL = "qrels AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), ranked AS (SELECT query_id, chunk_id, rank FROM lexical)"
METRICS_SQL = f"""{ALL_SQL}, {QRELS_SQL}, need AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY ALL),
  marked AS (SELECT r.query_id, r.rank, (q.chunk_id IS NOT NULL)::INT AS rel FROM ranked r LEFT JOIN qrels q USING (query_id, chunk_id) WHERE rank <= 5),
  run AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM marked),
  m AS (SELECT query_id, round(sum(rel) / any_value(n_rel), 6) AS recall, round(sum(rel) / count(*), 6) AS precision, round(coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS mrr,
      round(sum(rel / log2(rank + 1)) / list_sum(list_transform(range(1, least(any_value(n_rel), 5) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg,
      round(CASE WHEN sum(rel) > 0 THEN sum(CASE WHEN rel = 1 THEN hits / rank ELSE 0 END) / sum(rel) ELSE 0 END, 6) AS context_precision
    FROM need JOIN run USING (query_id) GROUP BY query_id)"""


def _metrics(spark, d):
    one = F.lit("all")
    asked = questions(spark, d).withColumn("tenant_id", one)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    ranked = L.bm25(asked, L.indexed(chunks(spark, d).withColumn("tenant_id", one)))
    return E.retrieval_metrics(ranked, E.holding(docs, asked.select("query_id", F.col("text").alias("item"))))


@query("retrieval_metrics", f"{METRICS_SQL} SELECT * FROM m")
def retrieval_metrics(spark, d):
    return _metrics(spark, d)


@query("macro_metrics", f"{METRICS_SQL} SELECT count(*) AS n_questions, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(context_precision), 6) AS context_precision FROM m")
def macro_metrics(spark, d):
    return E.macro(_metrics(spark, d))


@query("latency_percentiles_disc", "SELECT event_type AS stage, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, count(value) AS n FROM events GROUP BY event_type")
def latency_percentiles_disc(spark, d):
    return E.latency(table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


@query("percentile_linear", "SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentile_linear(spark, d):
    return E.interpolated(table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


GATE_ROWS = "(VALUES ('recall', 0.95, 'a'), ('mrr', 0.90, 'a'), ('p95', 10.0, 'a'), ('gone', 1.0, 'a'), ('cfg', 1.0, 'a'), ('none', NULL, 'a'))", "(VALUES ('recall', 0.94, 'a'), ('mrr', 0.70, 'a'), ('p95', 11.0, 'a'), ('new', 1.0, 'a'), ('cfg', 1.0, 'b'), ('none', NULL, 'a'))"


@query("regression_gate", f"""WITH b AS (SELECT * FROM {GATE_ROWS[0]} v(metric, was, bc)), c AS (SELECT * FROM {GATE_ROWS[1]} v(metric, cur, cc)), t AS (SELECT * FROM (VALUES ('recall', 0.02, 0.0, true), ('mrr', 0.02, 0.05, true), ('p95', 0.5, 0.2, false), ('cfg', 1.0, 0.0, true), ('none', 1.0, 0.0, true), ('gone', 1.0, 0.0, true)) v(metric, a, r, up))
  SELECT metric, CASE WHEN bc IS NULL OR cc IS NULL OR a IS NULL THEN 'fail' WHEN bc <> cc THEN 'refused' WHEN was IS NULL AND cur IS NULL THEN 'skipped' WHEN was IS NULL OR cur IS NULL THEN 'fail' WHEN (CASE WHEN up THEN was - cur ELSE cur - was END) > a + r * abs(was) THEN 'fail' ELSE 'pass' END AS verdict FROM b FULL JOIN c USING (metric) LEFT JOIN t USING (metric)""")
def regression_gate(spark, d):
    s = "metric string, value double, config string"
    b = spark.createDataFrame([("recall", 0.95, "a"), ("mrr", 0.90, "a"), ("p95", 10.0, "a"), ("gone", 1.0, "a"), ("cfg", 1.0, "a"), ("none", None, "a")], s)
    c = spark.createDataFrame([("recall", 0.94, "a"), ("mrr", 0.70, "a"), ("p95", 11.0, "a"), ("new", 1.0, "a"), ("cfg", 1.0, "b"), ("none", None, "a")], s)
    t = spark.createDataFrame([("recall", 0.02, 0.0, True), ("mrr", 0.02, 0.05, True), ("p95", 0.5, 0.2, False), ("cfg", 1.0, 0.0, True), ("none", 1.0, 0.0, True), ("gone", 1.0, 0.0, True)], "metric string, abs double, rel double, higher_is_better boolean")
    return E.gate(b, c, t)


@query("slugs", r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


@query("token_estimates", "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens, substr(sha256(lang || '|' || source), 1, 12) AS fingerprint FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.fingerprint(F.col("lang"), F.col("source")).alias("fingerprint"))


@query("host_trust", r"""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM pages), x AS (SELECT * FROM (VALUES ('com', 'unknown'), ('org', 'community'), ('example.com', 'official'), ('example.org', 'academic'), ('example', 'community')) v(domain, trust))
  SELECT page_id, lower(host) AS host, arg_max(domain, length(domain)) AS domain, arg_max(trust, length(domain)) AS trust FROM h LEFT JOIN x ON lower(host) = domain OR ends_with(lower(host), '.' || domain) GROUP BY ALL""")
def host_trust(spark, d):
    domains = spark.createDataFrame([("com", "unknown"), ("org", "community"), ("example.com", "official"), ("example.org", "academic"), ("example", "community")], "domain string, trust string")
    return T.with_trust(table(spark, d, "pages").select("page_id", "url"), domains).select("page_id", "host", "domain", "trust")


@query("question_intent", "SELECT conv_id, turn, CASE WHEN lower(text) LIKE '%roadmap%' OR lower(text) LIKE '%study plan%' OR lower(text) LIKE '%plan my%' THEN 'planner' WHEN lower(text) LIKE '%quiz%' THEN 'assessment' WHEN lower(text) LIKE '%recommend%' OR lower(text) LIKE '%resource%' OR lower(text) LIKE '%video%' THEN 'recommender' WHEN lower(text) LIKE '%mastery%' THEN 'progress' ELSE 'tutor' END AS intent FROM conversations WHERE role = 'user'")
def question_intent(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))
