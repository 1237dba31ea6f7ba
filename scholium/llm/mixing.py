"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit key drawn from its doc_id and text. Words are summed by
source and by the key's top 12 bits; the cumulative sum shows in which bucket a
source's budget ends. Only the rows of that bucket are summed again, by the next
12 bits, until one key is left. What lies below the key found is taken: a filter
with no sort of the rows.

Budgets are nested: a source whose target is 2.3 times its size takes every
row twice, and a third time the rows below the threshold of the last 0.3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from scholium.llm.common import fresh, key60, small, text_of, word_count, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BUCKET_BITS = 12
KEY_BITS = 60


def row_key():
    return key60(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of())


def sized(docs: DataFrame) -> DataFrame:
    """Adds size (words; a null text has none) and key to ``docs``."""
    return docs.withColumns({"size": word_count(), "key": row_key()})


def targets(per_source: DataFrame, weights=WEIGHTS, most=MAX_REPEATS) -> DataFrame:
    """source, source_size -> and target.

    Sources by code point, null last, weigh ``weights`` in turn. Shares beyond
    ``most`` times a source's size go to the others by weight: sources fill up
    in order of most * size / weight, and the rest get weight * level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    df = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    df = df.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", level)
    df = df.withColumn("final", F.min(F.when(F.col("level") < F.col("fills_at"), F.struct("fills_at", "level"))).over(everything)["level"])
    return df.select("source", "source_size", F.coalesce(F.least(F.col("weight") * F.col("final"), F.col("cap")), F.col("cap")).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, whole, below.

    ``rows`` (source, size, key) of a source are taken ``whole`` times, and once
    more where key < below. The row group at the boundary is taken if that comes
    nearer to the budget than leaving it.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("passed"), F.when(F.col("budget") <= 0, F.lit(0).cast("long")).alias("below"))
    state = written(state, "mix-goals")
    shift = KEY_BITS
    while shift and not state.where("below is null").isEmpty():
        open_ = state.where("below is null").select(F.col("source").alias("s"), "prefix", "budget", "passed")
        at, shift = shift, shift - BUCKET_BITS
        inside = rows.join(small(open_), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("key", at) == F.col("prefix")))
        # every field but the sums is the same within a source
        sums = inside.groupBy("s", "budget", "passed", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("key").alias("least"), F.max("key").alias("most"))
        running = F.sum("size").over(Window.partitionBy("s").orderBy("bucket")) + F.col("passed")
        reached = sums.withColumn("upto", running).where(F.col("upto") > F.col("budget"))
        edge = reached.groupBy("s").agg(F.min(F.struct("bucket", "upto", "size", "least", "most")).alias("edge"))
        before = F.col("edge.upto") - F.col("edge.size")
        nearer = F.col("edge.upto") + before <= 2 * F.col("budget")
        one = F.col("edge.least") == F.col("edge.most")
        everything = F.lit(1 << KEY_BITS).cast("long")
        state = written(state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "whole", "budget",
            F.coalesce(F.col("edge.bucket"), F.col("prefix")).alias("prefix"), F.coalesce(before, F.col("passed")).alias("passed"),
            F.when(F.col("below").isNotNull(), F.col("below")).when(F.col("edge").isNull(), everything).when(one & nearer, F.col("edge.least") + 1).when(one, F.col("edge.least")).alias("below")), "mix-state")
    return state.select("source", "source_size", "target", "whole", "below")


def with_copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and copies."""
    cuts = small(cuts.withColumnRenamed("source", "_source"))
    copies = F.col("whole") + F.when(F.col("key") < F.col("below"), 1).otherwise(0)
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", copies.cast("long")).drop("_source", "whole", "below")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``.

    Null texts have size 0 and null sources form one source, the last. Rows that
    agree in doc_id and text are taken alike. An empty table gives no rows.
    """
    rows = written(sized(docs).select("doc_id", "source", "size", "key"), "mix-rows")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    return with_copies(rows, thresholds(rows, goals)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, each as often as the mix takes it.

    A null text has no words; its rows are taken like others. Null sources form
    one source. Rows that agree in doc_id and text, or are repeated, are taken
    alike. An empty table gives no rows.
    """
    rows = written(sized(docs.select("doc_id", "source", "text")).select("source", "size", "key"), "mix-rows")
    cut, key, copy = (fresh(docs, x) for x in ("cut", "key", "copy"))
    cuts = thresholds(rows, targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))).select(F.struct("source", "whole", "below").alias(cut))
    copies = (F.col(f"{cut}.whole") + F.when(F.col(key) < F.col(f"{cut}.below"), 1).otherwise(0)).cast("int")
    taken = docs.withColumn(key, row_key()).join(small(cuts), F.col("source").eqNullSafe(F.col(f"{cut}.source"))).withColumn(copy, copies).where(F.col(copy) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).drop(cut, key, copy)
