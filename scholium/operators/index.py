"""A stored inverted index: postings, lengths and frequencies as tables, changed by document.

A term's postings are kept in blocks, those that can score best first. A block has
its largest tf and its least length: whatever the corpus becomes, no posting of it
scores more than these two would. Tables are partitioned by generation and, where a
term is looked up, by a bucket of (tenant, term), so that a question reads the
buckets of its terms alone.

A change writes a generation: the new chunks of some documents, what they add to
frequencies and lengths, and what the documents' former chunks take away. It counts
once its number stands in ``commits``, which is written last. What a run that broke
off has left is not read, and is overwritten by the next run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scholium.functions.text import STOPWORDS
from scholium.operators.lexical import B, K1, part, question_terms, top_k
from scholium.store import small, written

BUCKETS, BLOCK = 64, 256
#: Tokens whose terms are counted at a time, and postings of one term that are ordered at a time.
TOKENS, HELD = 1 << 21, 1 << 16
#: Scores are compared with six digits; a bound has to stay this far below to rule a block out.
MARGIN = 1e-5

SCHEMAS = {
    "chunks": "tenant_id string, document_id long, chunk_id long, token_count long, terms array<string>, gen int",
    "postings": "tenant_id string, term string, top_tf long, least_length long, n long, postings array<struct<tf:long,token_count:long,chunk_id:long>>, gen int, bucket int",
    "frequencies": "tenant_id string, term string, n long, gen int, bucket int",
    "lengths": "tenant_id string, n_chunks long, n_tokens long, gen int",
    "dead": "tenant_id string, chunk_id long, of_gen int, gen int",
    "commits": "documents long, gen int",
}
TABLES = tuple(SCHEMAS)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("tenant_id", "term"), F.lit(buckets)).cast("int")


def _counted(batches):
    """Chunks with their distinct terms, stop words left out, and how often each is said, instead of their tokens."""
    stop = pa.array(STOPWORDS)
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy()
        part_of = np.cumsum(sizes, dtype=np.int64) // TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(part_of)) + 1).tolist(), len(sizes)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            rows = batch.slice(i, j - i)
            coded = rows.column("tokens").flatten().dictionary_encode()
            names, codes = coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy()
            wanted = np.append(~pc.is_in(names, value_set=stop).to_numpy(zero_copy_only=False), False)  # the last: no token
            at, codes = np.repeat(np.arange(j - i), sizes[i:j])[wanted[codes]], codes[wanted[codes]]
            pairs, tf = np.unique(at * max(1, len(names)) + codes, return_counts=True)
            at, codes = np.divmod(pairs, max(1, len(names)))
            ends = pa.array(np.searchsorted(at, np.arange(j - i + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (names.take(pa.array(codes)), pa.array(tf, pa.int64()))]
            kept = ["tenant_id", "document_id", "chunk_id", "token_count"]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *lists], [*kept, "terms", "tfs"])


def _folded(block: int):
    """Blocks of postings that come with a term's rows in one run; of a very long run ``HELD`` postings at a time are put in order."""

    def blocks(rows: pa.RecordBatch, run: np.ndarray) -> pa.RecordBatch:
        tf, length = (rows.column(c).to_numpy() for c in ("tf", "token_count"))
        order = np.lexsort((pc.fill_null(rows.column("chunk_id"), 0).to_numpy(), length, -tf, run))
        tf, length, run, chunk = tf[order], length[order], run[order], rows.column("chunk_id").take(pa.array(order))
        at = np.arange(len(run))
        starts = np.flatnonzero((at - np.searchsorted(run, run)) % block == 0)
        ends = np.append(starts, len(run))
        postings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(tf), pa.array(length), chunk], ["tf", "token_count", "chunk_id"]))
        tenant, term, bucket = (rows.column(c).take(pa.array(order[starts])) for c in ("tenant_id", "term", "bucket"))
        return pa.RecordBatch.from_arrays([tenant, term, pa.array(tf[starts]), pa.array(np.minimum.reduceat(length, starts)), pa.array(np.diff(ends)), postings, bucket],
                                          ["tenant_id", "term", "top_tf", "least_length", "n", "postings", "bucket"])

    def fold(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not rows.num_rows:
                continue
            codes = [pc.fill_null(rows.column(c).dictionary_encode().indices, -1).to_numpy() for c in ("tenant_id", "term")]
            run = np.cumsum(np.append(0, np.logical_or(*(x[1:] != x[:-1] for x in codes))))
            done = len(run) if len(run) - (last := int(np.searchsorted(run, run[-1]))) >= HELD else last
            held = rows.slice(done) if done < len(run) else None
            if done:
                yield blocks(rows.slice(0, done), run[:done])
        if held is not None:
            yield blocks(held, np.zeros(held.num_rows, np.int64))

    return fold


class Index:
    """An index below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, block: int = BLOCK):
        self.spark, self.path, self.buckets, self.block = spark, path.rstrip("/"), buckets, block

    def _exists(self, table: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def generations(self) -> list[int]:
        """Numbers of the changes that count."""
        if not self._exists("commits"):
            return []
        return sorted(r["gen"] for r in self.spark.read.schema(SCHEMAS["commits"]).parquet(f"{self.path}/commits").select("gen").distinct().collect())

    def table(self, name: str) -> DataFrame:
        """A table as of the last change that counts."""
        gens = self.generations()
        if not gens:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}").where(F.col("gen").isin(gens))

    def _put(self, df: DataFrame, name: str, gen: int) -> None:
        parts = [c for c in ("bucket",) if c in df.columns]
        df.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.path}/{name}/gen={gen}")

    def live_chunks(self) -> DataFrame:
        """Chunks that no later change has replaced."""
        return self._without_dead(self.table("chunks"))

    def _without_dead(self, rows: DataFrame) -> DataFrame:
        dead = self.table("dead").select("tenant_id", "chunk_id", F.col("of_gen").alias("gen"))
        return rows.join(small(dead), ["tenant_id", "chunk_id", "gen"], "left_anti")

    def put(self, chunks: DataFrame, documents: DataFrame | None = None) -> int:
        """Replaces all chunks of some documents; gives the number of the change.

        ``chunks``: tenant_id, document_id, chunk_id (unique in a tenant), tokens,
        token_count, as ``lexical.analysed`` makes them. ``documents`` (tenant_id,
        document_id) names those that are replaced, also those that are left without
        chunks; else they are those of ``chunks``.
        """
        gen = max(self.generations(), default=-1) + 1
        counted = chunks.select("tenant_id", "document_id", "chunk_id", "token_count", "tokens").mapInArrow(_counted, SCHEMAS["chunks"].replace("gen int", "tfs array<long>"))
        counted = written(counted, "index-chunks")
        named = written((counted if documents is None else documents).select("tenant_id", "document_id").distinct(), "index-documents")
        old = written(self.live_chunks().join(small(named), ["tenant_id", "document_id"], "left_semi"), "index-old")
        self._put(counted.drop("tfs"), "chunks", gen)
        self._put(self._blocks(self._terms(counted)), "postings", gen)
        more = self.spark.read.schema(SCHEMAS["postings"]).parquet(f"{self.path}/postings").where(F.col("gen") == gen).select("tenant_id", "term", "n")
        lost = old.select("tenant_id", F.explode("terms").alias("term")).withColumn("n", F.lit(-1))
        change = more.unionByName(lost).groupBy("tenant_id", "term").agg(F.sum("n").alias("n")).where("n <> 0")
        self._put(change.withColumn("bucket", bucket_of(self.buckets)).repartition("bucket"), "frequencies", gen)
        sizes = counted.select("tenant_id", F.lit(1).alias("n"), "token_count").unionByName(old.select("tenant_id", F.lit(-1).alias("n"), (-F.col("token_count")).alias("token_count")))
        self._put(sizes.groupBy("tenant_id").agg(F.sum("n").alias("n_chunks"), F.sum("token_count").alias("n_tokens")), "lengths", gen)
        self._put(old.select("tenant_id", "chunk_id", F.col("gen").alias("of_gen")), "dead", gen)
        self._put(named.agg(F.count(F.lit(1)).alias("documents")), "commits", gen)
        return gen

    @staticmethod
    def _terms(counted: DataFrame) -> DataFrame:
        """tenant_id, chunk_id, token_count, term, tf; only rows of one key (tenant, chunk and length) are added up across rows."""
        keys = ["tenant_id", "chunk_id", "token_count"]
        again = written(counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys)), "repeated-chunks")

        def said(rows: DataFrame) -> DataFrame:
            return rows.select(*keys, F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(*keys, "t.terms", "t.tfs").toDF(*keys, "term", "tf")

        if again.isEmpty():
            return said(counted)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        several = said(counted.join(small(again), same, "left_semi")).groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))
        return said(counted.join(small(again), same, "left_anti")).unionByName(several)

    def _blocks(self, terms: DataFrame) -> DataFrame:
        """Postings in blocks. A term's rows come in one run, as its hash is sorted by; its blocks are cut out of the run as it passes."""
        rows = terms.select("tenant_id", "term", "tf", "token_count", "chunk_id", bucket_of(self.buckets).alias("bucket"), F.xxhash64("tenant_id", "term").alias("h"))
        return rows.repartition("bucket").sortWithinPartitions("h").drop("h").mapInArrow(_folded(self.block), SCHEMAS["postings"].replace("gen int, ", ""))

    def statistics(self, asked: DataFrame) -> DataFrame:
        """tenant_id, term, bucket, doc_freq, doc_count, avg_doc_len of the terms of ``asked`` (tenant_id, term, bucket: distinct)."""
        df = self._met(self.table("frequencies"), asked).groupBy("tenant_id", "term", "bucket").agg(F.sum("n").alias("doc_freq")).where("doc_freq > 0")
        corpus = self.table("lengths").groupBy("tenant_id").agg(F.sum("n_chunks").alias("doc_count"), F.sum("n_tokens").alias("n_tokens"))
        return df.join(small(written(corpus, "corpus")), "tenant_id").withColumn("avg_doc_len", F.when(F.col("doc_count") > 0, F.col("n_tokens") / F.col("doc_count"))).drop("n_tokens")

    def _met(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """``rows`` of the terms of ``asked``; only their buckets are read."""
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        return rows.where(F.col("bucket").isin(buckets)).join(small(asked.select("tenant_id", "term")), ["tenant_id", "term"], "left_semi")

    def asked_blocks(self, terms: DataFrame, wanted: DataFrame, met: DataFrame | None = None) -> DataFrame:
        """Blocks of the ``wanted`` terms (tenant_id, term, bucket), once for each row of ``terms`` that has one; all are written, also those ``met`` before."""
        met = self._met(self.table("postings"), wanted) if met is None else met
        return met.join(small(terms.drop("bucket")), ["tenant_id", "term"])

    def bm25(self, questions: DataFrame, k: int = 20, k1: float = K1, b: float = B) -> DataFrame:
        """query_id, tenant_id, chunk_id, score, rank: the k best chunks of the question's tenant, as ``lexical.bm25`` ranks them.

        A question's k-th best part of any one term is a score that its k-th best
        chunk has at least. A block is left out if it and the best blocks of the
        question's other terms stay below that; its chunks cannot be among the k.
        Only sums by chunk are shuffled; postings stay where they are read.
        """
        asked = written(question_terms(questions).withColumn("bucket", bucket_of(self.buckets)), "index-asked")
        wanted = written(asked.select("tenant_id", "term", "bucket").distinct(), "index-wanted")
        stats = written(self.statistics(wanted), "index-statistics")
        met = written(self._met(self.table("postings"), wanted).drop("bucket", "n"), "index-met")
        blocks = self.asked_blocks(written(asked.join(stats, ["tenant_id", "term", "bucket"]), "index-terms"), wanted, met)
        heads = blocks.select("query_id", "term", part(k1, b, "top_tf", "least_length").alias("bound"))
        best = heads.groupBy("query_id", "term").agg(F.max("bound").alias("best"))
        known = written(self._floors(asked, wanted, stats, met, k, k1, b), "index-floors")
        limits = best.withColumn("others", F.sum("best").over(Window.partitionBy("query_id")) - F.col("best")).join(known, "query_id", "left").select("query_id", "term", "others", F.coalesce("floor", F.lit(0.0)).alias("floor"))
        open_ = blocks.join(small(written(limits, "index-limits")), ["query_id", "term"]).where(part(k1, b, "top_tf", "least_length") + F.col("others") >= F.col("floor") - MARGIN)
        return self._ranked(open_, k, k1, b)

    def _floors(self, asked: DataFrame, wanted: DataFrame, stats: DataFrame, met: DataFrame, k: int, k1: float, b: float) -> DataFrame:
        """query_id, floor: the largest, over a question's terms, of the k-th best part among the postings of the term's first blocks.

        A term's postings are scored once, for all questions that have it.
        """
        rows = self.asked_blocks(stats, wanted, met)
        first = top_k(rows.withColumn("bound", part(k1, b, "top_tf", "least_length")), ["tenant_id", "term"], [F.desc("bound")], -(-k // self.block) + 1, "_n")
        each = first.select("tenant_id", "term", "gen", "doc_count", "doc_freq", "avg_doc_len", F.explode("postings").alias("p"))
        each = self._without_dead(each.select("tenant_id", "term", "gen", F.col("p.chunk_id").alias("chunk_id"), part(k1, b, F.col("p.tf"), F.col("p.token_count")).alias("part")))
        kth = top_k(each, ["tenant_id", "term"], [F.desc("part")], k, "_n").where(F.col("_n") == k).select("tenant_id", "term", F.col("part").alias("floor"))
        return asked.join(kth, ["tenant_id", "term"]).groupBy("query_id").agg(F.max("floor").alias("floor"))

    def _ranked(self, blocks: DataFrame, k: int, k1: float, b: float) -> DataFrame:
        each = blocks.select("query_id", "tenant_id", "gen", "doc_count", "doc_freq", "avg_doc_len", F.explode("postings").alias("p"))
        each = each.select("query_id", "tenant_id", "gen", F.col("p.chunk_id").alias("chunk_id"), part(k1, b, F.col("p.tf"), F.col("p.token_count")).alias("part"))
        total = each.groupBy("query_id", "tenant_id", "chunk_id", "gen").agg(F.sum("part").alias("part"))  # a chunk lives in one generation
        total = self._without_dead(total).select("query_id", "tenant_id", "chunk_id", F.round("part", 6).alias("score"))
        return top_k(total, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)

    def compacted(self, path: str) -> Index:
        """The same index in one generation below ``path``, without what was replaced."""
        new = Index(self.spark, path, self.buckets, self.block)
        live = self._without_dead(self.table("postings").select("tenant_id", "term", "gen", F.explode("postings").alias("p")).select("tenant_id", "term", "gen", "p.*"))
        chunks = self.live_chunks()
        tables = {
            "chunks": chunks.drop("gen"), "postings": new._blocks(live.select("tenant_id", "chunk_id", "token_count", "term", "tf")),
            "frequencies": self.table("frequencies").groupBy("tenant_id", "term", "bucket").agg(F.sum("n").alias("n")).where("n <> 0").repartition("bucket"),
            "lengths": self.table("lengths").groupBy("tenant_id").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")),
            "dead": self.table("dead").where("false").drop("gen"), "commits": chunks.agg(F.countDistinct("tenant_id", "document_id").alias("documents"))}
        for name in TABLES:
            new._put(tables[name], name, 0)
        return new
