"""Inverted index, its statistics, and BM25 for batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scholium.functions.text import index_terms, is_term, may_change, tokenize
from scholium.store import small, written

K1, B = 1.2, 0.75


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as there are cores, where they come in few files.

    A file of one row group is read by one task, however many splits it is cut into.
    Tables of many splits or files stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    few = rows.rdd.getNumPartitions() < 4 * cores and len(rows.inputFiles()) < cores
    return rows.repartition(cores) if few else rows


def analysed(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Adds tokens (stop words kept) and token_count. Only texts that NFKC may change go through Python."""
    chunks = spread(chunks)
    changes = F.coalesce(may_change(F.col(text)), F.lit(False))
    parts = [chunks.where(changes == x).withColumn("tokens", tokenize(F.col(text), normalise=x)) for x in (False, True)]
    return parts[0].unionByName(parts[1]).withColumn("token_count", F.size("tokens").cast("long"))


def indexed(chunks: DataFrame, *keep: str) -> DataFrame:
    """Analysed chunks (tenant_id, chunk_id, tokens, token_count and ``keep``), written once: texts are tokenised in one pass, whatever follows reads tokens."""
    return written(chunks.select("tenant_id", "chunk_id", "tokens", "token_count", *keep), "analysed")


def chunk_terms(chunks: DataFrame, keys=("tenant_id", "chunk_id")) -> DataFrame:
    """keys, term, tf of analysed chunks, stop words left out."""
    terms = chunks.select(*keys, F.explode("tokens").alias("term")).where(is_term(F.col("term")))
    return terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def chunk_words(chunks: DataFrame) -> DataFrame:
    """tenant_id, chunk_id, term as ``chunk_terms``, without tf: what document frequencies need.

    A chunk's terms are told apart within its row, so that nothing is shuffled. Keys
    of several rows are looked up first; only their terms go through ``chunk_terms``.
    ``chunks`` are read twice: best written ones.
    """
    keys = ["tenant_id", "chunk_id"]
    again = written(chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys)), "repeated-chunks")
    same = F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}")) & F.col(keys[1]).eqNullSafe(F.col(f"_{keys[1]}"))
    alone = chunks.join(small(again), same, "left_anti").select(*keys, F.explode(F.array_distinct(index_terms(F.col("tokens")))).alias("term"))
    return alone.unionByName(chunk_terms(chunks.join(small(again), same, "left_semi")).drop("tf"))


def doc_freq(terms: DataFrame) -> DataFrame:
    """Chunks per tenant and term; (chunk, term) is a key, so a count will do."""
    return terms.groupBy("tenant_id", "term").agg(F.count(F.lit(1)).alias("doc_freq"))


def updated_doc_freq(old: DataFrame, terms: DataFrame, affected: DataFrame) -> DataFrame:
    """doc_freq after a change: affected terms counted anew, vanished ones gone, the rest kept. Terms meet the affected ones as counts, not row by row."""
    keys = ["tenant_id", "term"]
    touched = affected.select(*keys).distinct()
    return old.join(touched, keys, "left_anti").unionByName(doc_freq(terms).join(touched, keys, "left_semi"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("token_count").alias("total_tokens"), F.avg("token_count").alias("avg_doc_len"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def question_terms(questions: DataFrame, text: str = "text") -> DataFrame:
    """Distinct terms of each question; a term counts once however often it is said."""
    return questions.select("query_id", "tenant_id", F.explode(F.array_distinct(index_terms(tokenize(F.col(text))))).alias("term"))


def bm25(questions: DataFrame, chunks: DataFrame, k: int = 20, k1: float = K1, b: float = B, terms: DataFrame | None = None) -> DataFrame:
    """query_id, tenant_id, chunk_id, score, rank: the k best chunks of the question's tenant.

    Ordered by score (six digits), then chunk id. Tokens meet the questions' terms
    before they are counted, so only matching ones move; document frequencies are
    written, so that Spark can split the join of a hot term.
    """
    key = ["tenant_id", "term"]
    asked = written(question_terms(questions), "question-terms")
    wanted = asked.select(*key).distinct()
    if terms is None:
        said = chunks.select("tenant_id", "chunk_id", F.explode("tokens").alias("term")).join(small(wanted), key, "left_semi")
        terms = written(said.groupBy("tenant_id", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf")), "asked-terms")
    else:
        terms = terms.join(small(wanted), key, "left_semi")
    stats = small(written(doc_freq(terms), "asked-frequencies"))
    lengths = chunks.select("tenant_id", "chunk_id", "token_count")
    found = terms.join(stats, key).join(small(written(corpus_stats(chunks), "corpus-stats")), "tenant_id").join(lengths, ["tenant_id", "chunk_id"])
    parts = found.select("tenant_id", "chunk_id", "term", part(k1, b).alias("part")).join(small(asked), key)
    total = parts.groupBy("query_id", "tenant_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(total, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def part(k1: float = K1, b: float = B, tf: str | Column = "tf", length: str | Column = "token_count") -> Column:
    """What a term adds to a chunk's score; rows have doc_count, doc_freq and avg_doc_len. It grows with tf and falls with the length."""
    tf, length = (F.col(x) if isinstance(x, str) else x for x in (tf, length))
    norm = F.when(F.col("avg_doc_len") > 0, length / F.col("avg_doc_len")).otherwise(0.0)
    return idf(F.col("doc_count"), F.col("doc_freq")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group, ranked from 1; Spark keeps k rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def degradations(questions: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id and why the lexical side of a question cannot answer, if so."""
    terms = F.size(index_terms(tokenize(F.col("text"))))
    known = stats.select("tenant_id", "doc_count")
    return questions.withColumn("n_terms", terms).join(known, "tenant_id", "left").select(
        "query_id", F.array_compact(F.array(F.when(F.col("n_terms") == 0, F.lit("empty_query_terms")), F.when(F.col("doc_count").isNull(), F.lit("no_corpus_stats")))).alias("degraded"))
