"""What the training-data operators share: word and size expressions, written
intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word, by contract: a maximal run of bytes that are no ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows, and bytes of their values, up to which a per-key summary is broadcast; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Folders of the runs that are open, the innermost last.
_runs: list[str] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A session on a cluster must name one. In a local session that names none, as
    in tests, a temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='scholium-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder of the open run, or else in the shared folder."""
    return f"{_runs[-1] if _runs else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def run_folder(spark: SparkSession):
    """Tables that are written inside are dropped at its end; results must be written elsewhere before."""
    _runs.append(place(spark, "run"))
    try:
        yield _runs[-1]
    finally:
        drop(spark, _runs.pop())


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back.

    Cuts the lineage: later jobs, retried tasks and other branches of a plan see
    the same rows, also where an executor that made them is lost.
    """
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table for broadcasting if it has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes."""
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD_PATTERN)).cast("long")


def key60(*columns: Column) -> Column:
    """The first 60 bits of an MD5, as a non-negative long."""
    digest = F.md5(F.concat_ws("\x1f", *columns))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``chosen`` (doc_id, text_sha256) names, each once.

    Rows of ``docs`` that agree in doc_id and text are one row here, whatever
    their other columns hold; only such rows are grouped, by themselves.
    """
    own, name = fresh(docs, "own"), fresh(docs, "name")
    marked = docs.withColumn(own, F.struct(F.col("doc_id").alias("id"), F.sha2(text_of().cast("binary"), 256).alias("sha")))
    names = chosen.select(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias(name))
    same = (F.col(f"{own}.sha") == F.col(f"{name}.sha")) & F.col(f"{own}.id").eqNullSafe(F.col(f"{name}.id"))
    rows = marked.join(names, same, "left_semi")
    repeated = marked.groupBy(own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(own).alias(name))
    repeated = written(repeated, "repeated-rows")
    if repeated.isEmpty():
        return rows.drop(own)
    once = rows.join(repeated, same, "left_semi").dropDuplicates([own])
    return rows.join(repeated, same, "left_anti").unionByName(once).drop(own)
