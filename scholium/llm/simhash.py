"""SimHash near-deduplication by a binary trie self-join.

Distinct fingerprints are put into binary tries and each trie is joined with
itself: a pair of nodes carries the bits in which their prefixes differ; it is
followed to the pairs of their children and dropped once more than
``MAX_BITS`` bits differ.

One trie of all fingerprints would have its widest level at log2 of their
number. So there are ten, each over the fingerprints with the bits in another
order: the 64 bits are five blocks, and two fingerprints that differ in three
bits agree in at least two blocks. A trie's first bits are one such pair of
blocks; only nodes that agree in these are joined. Spark groups fingerprints by
them. A pair of nodes with up to ``NODE_ROWS`` fingerprints is traversed in a
task, bit by bit; a larger one is split in Spark by its next ``STEP`` bits.

A task returns the links as a spanning forest, not all pairs.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholium.llm.common import only, text_of, written
from scholium.llm.components import components

MAX_BITS = 3
SEED = 42
SHINGLE = 3
BLOCKS = (13, 13, 13, 13, 12)
STEP = 8
NODE_ROWS = 50_000
#: Node pairs that a task expands at a time.
FRONTIER = 1 << 14
ORDERS = [(a, b, *(x for x in range(5) if x not in (a, b))) for a, b in itertools.combinations(range(5), 2)]


def fingerprint(raw: bytes) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    words = raw.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(SHINGLE)), strict=False)] or [b" ".join(words)]
    hashes = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, len(shingles))
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, further columns ``keep`` and fp of each row of ``docs``."""
    columns = ["doc_id", *keep]

    def made(batches):
        for batch in batches:
            fps = [fingerprint(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(fps, pa.int64())], [*columns, "fp"])

    rows = docs.select(*columns, "text")
    schema = rows.drop("text").schema.add("fp", "long")
    return rows.mapInArrow(made, schema)


def _starts(order) -> list[tuple[int, int, int]]:
    """(shift in the fingerprint, width, shift in the reordered one) of each block, in order."""
    out, left = [], 64
    for b in order:
        left -= BLOCKS[b]
        out.append((64 - sum(BLOCKS[: b + 1]), BLOCKS[b], left))
    return out


def _reordered(order):
    parts = (F.shiftleft(F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1), to) for at, width, to in _starts(order))
    return functools.reduce(lambda a, b: a.bitwiseOR(b), parts)


def restore(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Fingerprints of reordered ones (unsigned), given each one's table."""
    out = np.zeros_like(values)
    for t, order in enumerate(ORDERS):
        own = table == t
        if own.any():
            v = values[own]
            out[own] = functools.reduce(np.bitwise_or, (((v >> np.uint64(to)) & np.uint64((1 << width) - 1)) << np.uint64(at) for at, width, to in _starts(order)))
    return out


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n indices is linked to."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def traverse(values: np.ndarray, nodes: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between indices of ``values`` that join all that differ in ``most`` bits or fewer.

    ``nodes``: rows (depth, a, a end, b, b end, differing bits) of node pairs; a
    node is a sorted range of ``values`` that agree in their first ``depth``
    bits. The nodes of a pair are the same range or apart.
    """
    n = len(values)
    label, breaks = np.arange(n), np.arange(n)  # breaks: how often the label changes up to an index
    ones: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return ones[depth]

    def members(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sizes = end - start
        return np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    stack = [(int(d), nodes[nodes[:, 0] == d, 1:]) for d in np.unique(nodes[:, 0])]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(depth, pairs[:FRONTIER]), (depth, pairs[FRONTIER:])]
            continue
        # a node with itself needs two members; nodes whose members are all linked already have no more to give
        linked = (breaks[pairs[:, 1] - 1] == breaks[pairs[:, 0]]) & (breaks[pairs[:, 3] - 1] == breaks[pairs[:, 2]]) & (label[pairs[:, 0]] == label[pairs[:, 2]])
        pairs = pairs[~linked & ((pairs[:, 0] != pairs[:, 2]) | (pairs[:, 1] - pairs[:, 0] > 1))]
        within = pairs[:, 4] + 64 - depth <= most  # whatever follows, all of both nodes are near
        if within.any():
            a, a_end, b, b_end, _ = pairs[within].T
            i = np.concatenate([np.arange(n), np.repeat(a, a_end - a), np.repeat(a, b_end - b)])
            j = np.concatenate([label, members(a, a_end), members(b, b_end)])
            label = label[_forest(n, i, j)]
            breaks = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            pairs = pairs[~within]
        if not len(pairs) or depth == 64:
            continue
        sums = ones_before(depth)
        a, a_end, b, b_end, bits = pairs.T
        a_mid, b_mid = a_end - (sums[a_end] - sums[a]), b_end - (sums[b_end] - sums[b])
        same = a == b
        children = np.concatenate([
            np.stack([a, a_mid, b, b_mid, bits], 1), np.stack([a_mid, a_end, b_mid, b_end, bits], 1),
            np.stack([a, a_mid, b_mid, b_end, bits + 1], 1), np.stack([a_mid, a_end, b, b_mid, bits + 1], 1)[~same]])
        children = children[(children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= most)]
        if len(children):
            stack.append((depth + 1, children))
    moved = np.flatnonzero(label != np.arange(n))
    return label[moved], moved


def _task(batches):
    """Traverses the node pairs of a batch at once and yields their links."""
    for batch in batches:
        table, depth, bits = (batch.column(c).to_numpy() for c in ("t", "depth", "bits"))
        values, tables, rows, at = [], [], [], 0
        for k, (left, right) in enumerate(zip(batch.column("a_values"), batch.column("b_values"), strict=True)):
            spans = []
            for side in (left, right) if right.is_valid else (left,):
                v = np.sort(side.values.to_numpy().view(np.uint64))
                values.append(v)
                tables.append(np.full(len(v), table[k]))
                spans += [at, at + len(v)]
                at += len(v)
            rows.append((depth[k], *(spans * 2 if len(spans) == 2 else spans), bits[k]))
        if not rows:
            continue
        v = np.concatenate(values)
        i, j = traverse(v, np.array(rows, np.int64))
        fp = restore(v, np.concatenate(tables)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["u", "v"])


def _nodes(rows: DataFrame, depth: int) -> DataFrame:
    return rows.groupBy("t", F.shiftrightunsigned("value", 64 - depth).alias("node"))


def _gathered(items: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """t, node, values of the nodes that ``items`` name; others are dropped before any group is made."""
    asked = items.select("t", F.col("a").alias("node")).union(items.select("t", F.col("b").alias("node"))).distinct()
    named = rows.withColumn("node", F.shiftrightunsigned("value", 64 - depth)).join(asked, ["t", "node"], "left_semi")
    return named.groupBy("t", "node").agg(F.collect_list("value").alias("values"))


def _traversed(items: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """Links found below node pairs of bounded size."""
    lists = _gathered(items, rows, depth)
    a = lists.select("t", F.col("node").alias("a"), F.col("values").alias("a_values"))
    b = lists.select("t", F.col("node").alias("b"), F.col("values").alias("b_values"))
    own, apart = items.where("a = b").join(a, ["t", "a"]).withColumn("b_values", F.lit(None).cast("array<long>")), items.where("a <> b").join(a, ["t", "a"]).join(b, ["t", "b"])
    columns = ["t", F.lit(depth).alias("depth"), "bits", "a_values", "b_values"]
    return own.select(*columns).unionByName(apart.select(*columns)).mapInArrow(_task, "u long, v long")


def links(fps: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """(u, v): links that join all distinct fingerprints (column fp) differing in ``MAX_BITS`` bits or fewer."""
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), _reordered(order).alias("value")) for t, order in enumerate(ORDERS))))
    spread = fps.select("fp", tables.alias("x")).select("x.*")
    depth = min(sum(BLOCKS[x] for x in order[:2]) for order in ORDERS)  # 25: one block has 12 bits
    shared = written(_nodes(spread, depth).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "trie-nodes")
    rows = written(spread.withColumn("node", F.shiftrightunsigned("value", 64 - depth)).join(shared, ["t", "node"], "left_semi").select("t", "value"), "trie-rows")
    items = shared.select("t", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("bits"), F.col("n").alias("size"))
    found = None
    while True:
        small = items.where((F.col("size") <= node_rows) | F.lit(depth == 64))
        here = written(_traversed(small, rows, depth), "links")
        found = here if found is None else found.unionByName(here)
        large = items.where((F.col("size") > node_rows) & F.lit(depth < 64))
        if large.isEmpty():
            return found
        parent, depth = depth, min(64, depth + STEP)
        children = _nodes(rows, depth).agg(F.count(F.lit(1)).alias("n")).withColumn("parent", F.shiftrightunsigned("node", depth - parent))
        side = lambda x: children.select("t", F.col("parent").alias(x), F.col("node").alias(f"{x}2"), F.col("n").alias(f"n_{x}"))
        pairs = large.join(side("a"), ["t", "a"]).join(side("b"), ["t", "b"]).where("a <> b or a2 <= b2")
        pairs = pairs.withColumn("bits", F.col("bits") + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND((1 << (depth - parent)) - 1)))
        size = F.when(F.col("a2") == F.col("b2"), F.col("n_a")).otherwise(F.col("n_a") + F.col("n_b"))
        items = written(pairs.where(F.col("bits") <= MAX_BITS).select("t", F.col("a2").alias("a"), F.col("b2").alias("b"), "bits", size.alias("size")), "trie-pairs")


def _with_components(rows: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Adds root, a fingerprint that stands for the component, to ``rows`` with fp."""
    distinct = written(rows.select("fp").distinct(), "fingerprints")
    roots = components(links(distinct, node_rows))
    return rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``.

    A null text is empty; texts without a word have fingerprint zero and are
    linked like others. Null doc_ids never name a component unless it has no
    other; repeated doc_ids and repeated rows keep their rows. An empty table
    gives no rows.
    """
    rows = written(fingerprints(docs), "simhash")
    rooted = written(_with_components(rows, node_rows), "simhash-roots")
    names = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-names")  # so that Spark can split the join of a hot root
    return rooted.join(names, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names: of each component the row with the smallest doc_id.

    A null text is empty; texts without a word are one component, together with
    fingerprints near zero. A null doc_id stays only if the component has no
    other; of repeated rows one stays. An empty table gives no rows.
    """
    rows = written(fingerprints(docs.withColumn("text_sha256", F.sha2(text_of().cast("binary"), 256)), "text_sha256"), "simhash")
    rooted = _with_components(rows)
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_sha256")).alias("best"))
    return only(docs, best.select("best.doc_id", "best.text_sha256"))
