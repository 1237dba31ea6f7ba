"""Sharding by a minimax contiguous partition.

Equal texts are one atomic group; groups are ordered by a 60-bit key of their
text. The smallest capacity under which a greedy left-to-right packing needs no
more shards than there are is found by binary search, and the order is cut where
that packing cuts.

The driver never sees the groups, only sums of sizes over key ranges: at first
4096 ranges. Cuts can fall only inside a few of them (each cut lies between that
of a greedy packing of whole ranges under the least possible capacity and that
of an ideal packing under a capacity known to do). Those ranges alone are summed
again over 256 finer ones, until the ranges where a cut may fall hold one group
each. The number of ranges stays within a few ten thousand at any size of input.

A group larger than the mean of the shards still open gets a shard of its own,
so that one hot text does not leave other shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from scholium.llm.common import key60, text_of, written

SHARDS = 24
KEY_BITS, FIRST_BITS, NEXT_BITS = 60, 12, 8
ROW_OVERHEAD = 8
SLOT_ROWS = 10_000


def greedy_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Where a greedy packing ends each shard, as counts of ranges; ``ends`` are running sums."""
    cuts, start = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, start + capacity, side="right"))
        cuts.append(at)
        start = int(ends[at - 1]) if at else 0
    return cuts


def least_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity for which ``sizes``, in order, fit into ``shards``."""
    if not len(sizes):
        return 0
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(ends, middle, shards)[-1] == len(sizes):
            high = middle
        else:
            low = middle + 1
    return low


def _sums(rows: DataFrame, shift: int) -> list[tuple]:
    """(range, bytes, single) of the ranges of 2**shift keys; their number is bounded by the caller."""
    found = rows.groupBy(F.shiftright("key", shift).alias("range")).agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single"))
    return [(x["range"] << shift, shift, x["size"], x["single"]) for x in found.collect()]


def cut_keys(rows: DataFrame, shards: int, largest: int) -> list[int]:
    """The first key of shard 1, 2, ... under the least capacity; ``rows`` have key and size."""
    ranges = sorted(_sums(rows, KEY_BITS - FIRST_BITS))
    while True:
        sizes = np.array([x[2] for x in ranges], dtype=np.int64)
        ends = np.cumsum(sizes)
        if not len(sizes):
            return []
        enough = least_capacity(sizes, shards)
        least = max(largest, -(-int(ends[-1]) // shards))
        early, wanted = greedy_cuts(ends, least, shards), {}
        for j, at in enumerate(early, 1):
            upto = int(np.searchsorted(ends, j * enough, side="left"))
            for i in range(at, min(upto + 1, len(ranges))):
                if not ranges[i][3]:
                    wanted[i] = ranges[i]
        if not wanted:
            return [ranges[at][0] for at in greedy_cuts(ends, enough, shards)[:-1] if at < len(ranges)]
        finer = []
        for shift in {x[1] for x in wanted.values()}:
            heads = [x[0] >> shift for x in wanted.values() if x[1] == shift]
            finer += _sums(rows.where(F.shiftright("key", shift).isin(heads)), max(0, shift - NEXT_BITS))
        ranges = sorted([x for i, x in enumerate(ranges) if i not in wanted] + finer)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``.

    A null text is empty. Null and repeated doc_ids and repeated rows keep their
    own rows and slots. A shard's slots are dealt out in parts of about
    ``SLOT_ROWS`` rows, so that no shard, and no doc_id or text with very many
    rows, is sorted in one task. Other columns are not looked at. Texts whose 60-bit keys agree stay together. With fewer
    groups than shards some shards are empty; an empty table gives no rows.
    """
    text = text_of()
    rows = written(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key60(text).alias("key")), "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    top = rows.groupBy("key").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "key").limit(shards + 1).collect()
    alone, left = [], total
    for key, size in top:
        if len(alone) == shards - 1 or size * (shards - len(alone)) <= left:
            break
        alone.append(key)
        left -= size
    rest = rows.where(~F.col("key").isin(alone)) if alone else rows
    cuts = cut_keys(rest, shards - len(alone), top[len(alone)][1] if len(top) > len(alone) else 0)
    place = sum((F.when(F.col("key") >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    for i, key in enumerate(alone):
        place = F.when(F.col("key") == key, shards - len(alone) + i).otherwise(place)
    parts = max(1, -(-n // (SLOT_ROWS * shards)))
    placed = rows.withColumn("shard", place.cast("int")).withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("offset"))
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key", "uid")) - 1 + F.col("offset")
    return placed.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
