"""Tables written between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows, and bytes of their values, up to which a table is broadcast; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that names no folder gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='scholium-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below the shared folder and reads it back.

    What follows reads it as often as it likes, and no executor's own disk is
    relied on.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes."""
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))).first()
    return n <= rows and size <= BROADCAST_BYTES


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcasting if it has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes."""
    return F.broadcast(df) if fits(df, rows) else df
