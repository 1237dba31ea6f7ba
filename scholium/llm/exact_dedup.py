"""Exact deduplication by deterministic block naming.

A text is cut into blocks of ``BLOCK_BYTES`` bytes. Distinct blocks are sorted
and numbered; that number is a block's name. Then adjacent names of a document
are paired, the distinct pairs are sorted and numbered in turn, and so on until
each document has one name. Two documents have the same number of blocks and
the same last name just if their texts are the same bytes.

The first level compares whole blocks. A 128-bit key carries a block's name back
to its documents; that the key tells all distinct blocks apart is verified on
every run, and another seed is taken if it does not. So no result rests on a
hash being free of collisions.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window, functions as F

from scholium.llm.common import only, text_of, written

BLOCK_BYTES = 4096


def _blocks(block_bytes: int):
    """All blocks of a text as an array of binaries; an empty text is one empty block."""
    raw = text_of().cast("binary")
    last = F.floor((F.greatest(F.octet_length(raw), F.lit(1)) - 1) / block_bytes).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def _keys(block, seed: int, bits: int) -> tuple:
    """Two hashes of a block. ``bits`` is only lowered to test a clash."""
    pair = F.xxhash64(block, F.lit(seed)), F.xxhash64(F.lit(~seed), block)
    return tuple(F.shiftrightunsigned(x, 64 - bits) if bits < 64 else x for x in pair)


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Sorts each hash partition and numbers its rows; numbers are unique over all."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, block_bytes: int, bits: int) -> tuple[DataFrame, int, int]:
    for seed in itertools.count(1):
        blocks = docs.select(F.explode(_blocks(block_bytes)).alias("block"))
        k1, k2 = _keys(F.col("block"), seed, bits)
        distinct = blocks.select(k1.alias("k1"), k2.alias("k2"), "block").distinct()
        names = written(_numbered(distinct, ["k1", "k2", "block"]).select("k1", "k2", "name"), "block-names")
        if names.groupBy("k1", "k2").count().where("count > 1").isEmpty():
            return names, seed, bits
        bits = min(64, bits + 16)


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """uid, doc_id, text_sha256, n_blocks, name of each row of ``docs``.

    (n_blocks, name) are equal just for equal texts. A null text is empty; rows
    are told apart by uid, so null or repeated doc_ids and repeated rows each
    keep their own row; other columns are not looked at.
    """
    names, seed, bits = _first_names(docs, block_bytes, bits)
    keys = F.transform(_blocks(block_bytes), lambda b: F.struct(*(k.alias(n) for k, n in zip(_keys(b, seed, bits), ("k1", "k2"), strict=True))))
    head = written(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.sha2(text_of().cast("binary"), 256).alias("text_sha256"), keys.alias("keys")), "block-docs")
    rows = head.select("uid", F.posexplode("keys").alias("pos", "key")).select("uid", "pos", "key.*")
    rows = written(rows.join(names, ["k1", "k2"]).select("uid", "pos", "name"), "named-0")
    longest = head.agg(F.max(F.size("keys"))).first()[0] or 1
    done = []
    for level in range((longest - 1).bit_length()):
        single = Window.partitionBy("uid")
        rows = rows.withColumn("n", F.max("pos").over(single))
        done.append(rows.where("n = 0").select("uid", "name"))
        half = rows.where("n > 0").groupBy("uid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        half = written(half, f"pairs-{level + 1}")
        pairs = written(_numbered(half.select("a", "b").distinct(), ["a", "b"]), f"pair-names-{level + 1}")  # so that Spark can split the join of a hot pair
        rows = written(half.join(pairs, ["a", "b"]).select("uid", "pos", "name"), f"named-{level + 1}")
    last = rows.select("uid", "name")
    for x in done:
        last = last.unionByName(x)
    return head.select("uid", "doc_id", "text_sha256", F.size("keys").alias("n_blocks")).join(last, "uid")


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Of equal texts the row with the largest doc_id stays (a null doc_id only if
    all are null; of repeated rows with that doc_id, one). An empty table gives
    no rows.
    """
    rows = written(identities(docs, **options), "identities")
    groups = rows.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", (-F.col("uid")).alias("order"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "groups")  # so that Spark can split the join of a hot group
    return rows.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("uid") == -F.col("best.order")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, without the copies.

    Of equal texts the row with the largest doc_id stays; a null text is empty, a
    null doc_id stays only if all are null, and of repeated rows one stays. An
    empty table gives no rows.
    """
    return only(docs, exact_groups(docs).where("kept"))
