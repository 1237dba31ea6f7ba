"""A Merkle manifest of a data set: each row is a leaf, each source a tree, and the sources' tops form one tree more.

A level is one window: nodes are partitioned by their tree and parent index, and
an ordered list over the whole frame gives both what the parent's digest is of
and, without the node itself, the node's siblings. Parents are deduplicated before
the next level, so each level has a sixteenth of the rows of the one before.

Where a leaf stands among those of its source comes from a range partitioning
and the counts of its parts, not from a window over the source: a source may hold
any share of all rows. Paths are joined from the top down, so that what leaves have
in common above them is put together once per node.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from scholium.llm.common import small, written

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: One row in so many, by the CRC-32 of its doc_id, is tampered with for the trial.
TAMPER_EVERY = 5


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 bytes, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    as_text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """A row's digest; ``text`` stands in for its text."""
    return digest(*(field(F.col(c) if c != "text" or text is None else text) for c in COLUMNS))


def placed(nodes: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Adds idx (from 0, by ``order`` within ``tree``, which is never null) and n (nodes of the tree).

    Rows are dealt out by range and sorted in their parts. Counts of (tree, part)
    tell where each part starts, so a tree of any size is spread over tasks.
    """
    serial = F.monotonically_increasing_id()
    parts = nodes.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    parts = written(parts.withColumn("serial", serial).withColumn("part", F.shiftright("serial", 33)), f"{name}-parts")
    counts = parts.groupBy(F.col(tree).alias("t"), F.col("part").alias("p")).agg(F.min("serial").alias("first"), F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy("t")
    starts = counts.select("t", "p", (F.sum("here").over(whole.orderBy("p")) - F.col("here") - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n"))
    starts = small(written(starts, f"{name}-starts"))
    here = (F.col(tree) == F.col("t")) & (F.col("part") == F.col("p"))
    return parts.join(starts, here).withColumn("idx", F.col("serial") + F.col("shift")).drop("serial", "part", "shift", "t", "p")


@dataclass
class Forest:
    """Levels of steps (tree, idx, parent, before, after) from the leaves up, and each tree's top (tree, digest, level).

    The lowest level also has the other columns of the nodes that it was made from.
    """

    levels: list[DataFrame]
    tops: DataFrame

    def paths(self, above: DataFrame, keep: list[str], lowest: int) -> DataFrame:
        """tree, idx, path of every node of level ``lowest``, with the columns ``keep`` of ``above``.

        ``above`` has what lies over each top: tree, path and ``keep``. A path is a
        list of (before, after), the siblings' digests to the left and right, upwards.
        """
        tops = above.join(self.tops.select("tree", "level"), "tree")
        found = None
        for level in range(len(self.levels), lowest - 1, -1):
            here = tops.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "path", *keep)
            if found is not None:
                here = here.unionByName(under(self.levels[level], found, keep).select("tree", "idx", "path", *keep))
            found = written(here, f"paths-{level}")
        return found


def under(steps: DataFrame, paths: DataFrame, keep: list[str]) -> DataFrame:
    """``steps`` with path and ``keep``, by the paths of their parents."""
    over = paths.select("tree", F.col("idx").alias("parent"), F.col("path").alias("rest"), *keep)
    return steps.join(over, ["tree", "parent"]).withColumn("path", F.concat(F.array(F.struct("before", "after")), "rest"))


def grown(nodes: DataFrame) -> Forest:
    """All levels over ``nodes`` (tree: never null, idx, n, digest, and columns that the lowest level keeps)."""
    levels, tops, kept = [], [], [c for c in nodes.columns if c not in ("tree", "idx", "n")]
    while True:
        tops.append(nodes.where("n = 1").select("tree", "digest", F.lit(len(levels)).alias("level")))
        open_ = nodes.where("n > 1")
        if open_.isEmpty():
            break
        run = Window.partitionBy("tree", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        held = open_.withColumn("parent", F.floor(F.col("idx") / FANOUT)).withColumn("run", F.collect_list("digest").over(run))
        own = (F.col("idx") % FANOUT).cast("int")
        step = held.select(
            "tree", "idx", "parent", "n", *kept, F.sha2(F.array_join("run", ""), 256).alias("over"),
            F.array_join(F.slice("run", F.lit(1), own), "").alias("before"), F.array_join(F.slice("run", own + 2, F.lit(FANOUT)), "").alias("after"))
        step = written(step, f"level-{len(levels)}")
        levels.append(step.drop("n", "over"))
        parents = step.select("tree", F.col("parent").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"), F.col("over").alias("digest"))
        nodes, kept = written(parents.dropDuplicates(["tree", "idx"]), f"nodes-{len(levels)}"), ["digest"]
    return Forest(levels, written(reduce(DataFrame.unionByName, tops), "tops"))


def folded(start: Column, path: Column) -> Column:
    """The top's digest that follows from a leaf and its path."""
    return F.aggregate(path, start, lambda over, step: F.sha2(F.concat(step["before"], over, step["after"]), 256))


def proof(path: Column) -> Column:
    """All siblings' digests of a path, upwards and from left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def manifest(docs: DataFrame, changed: Column | None = None, shown: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, shown_leaf, subroot, root, path: one row per row of ``docs``.

    Leaves of a source ascend by doc_id (null first), rows that agree in both by
    their digest; repeated rows have a leaf each. Sources ascend bytewise, null
    first. Null values and empty texts have digests of their own; only the columns
    of ``COLUMNS`` are looked at, and those that ``docs`` lacks count as null. A
    table without rows has no root and gives no rows.

    ``shown_leaf`` is the leaf of the row with its text replaced by ``shown`` where
    ``changed`` holds: what a reader would compute from a copy that was altered.
    """
    for c in COLUMNS:
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    altered = F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(False)
    shown_leaf = F.when(altered, leaf(shown if shown is not None else F.col("text")))
    leaves = docs.select("doc_id", "source", leaf().alias("digest"), shown_leaf.alias("shown_leaf"), F.monotonically_increasing_id().alias("uid"))
    # trees by a name that is never null; "-" sorts before "=", so that null sources come first and the others bytewise
    leaves = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    leaves = written(placed(written(leaves, "leaves"), "tree", ["doc_id", "digest", "uid"], "leaves").drop("uid"), "placed-leaves")
    trees = grown(leaves)
    tops = placed(trees.tops.select("tree", "digest", F.lit("all").alias("whole")), "whole", ["tree"], "sources")
    tops = written(tops.select(F.col("whole").alias("tree"), "idx", "n", "digest", F.col("tree").alias("of")), "placed-sources")
    top = grown(tops)
    nothing, both = F.array().cast("array<struct<before:string,after:string>>"), ["subroot", "root"]
    root = top.tops.select("tree", nothing.alias("path"), F.col("digest").alias("root"))
    over = top.paths(root, ["root"], 0).drop("tree").join(tops.select("idx", F.col("of").alias("tree"), F.col("digest").alias("subroot")), "idx")
    over = written(over.select("tree", "path", *both), "source-paths")
    rows = leaves.where("n = 1").join(over, "tree")
    if trees.levels:
        columns = ["doc_id", "source", "digest", "shown_leaf", "path", *both]
        rows = rows.select(columns).unionByName(under(trees.levels[0], trees.paths(over, both, 1), both).select(columns))
    return rows.select("doc_id", "source", F.col("digest").alias("leaf"), F.coalesce("shown_leaf", "digest").alias("shown_leaf"), *both, "path")


def tamper_trial(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest, and whether altered rows are found out.

    Rows whose doc_id's CRC-32 is divisible by ``TAMPER_EVERY`` are shown with
    their text's A-Z lower-cased; a null text stays null, and a row without
    doc_id is not altered. Such a row is verified only if its text has no A-Z.
    Order, nulls, repeated rows and empty tables: see ``manifest``.
    """
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = manifest(docs, altered, lowered)
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded(F.col("shown_leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
