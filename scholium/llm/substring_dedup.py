"""Substring deduplication over words by fixed-block anchors.

A text's words are cut into blocks of ``BLOCK`` = window / 2 words; the blocks of
all texts are the index. Every rolling run of ``BLOCK`` words of a text probes
it. Any window holds a whole block of the text it came from, so a window that
occurs in another text holds a probe that hits. A hit is extended to all windows
around it that hold its block, on both sides. Windows are compared by the first
128 bits of the SHA-256 of their words; a window is removed if one of the same
words starts in a text with a smaller doc_id. Runs of such windows are the
maximal exact repeats. So a passage that very many texts share is compared by
grouping its windows, never text by text. Hashes of blocks and seeds only choose
what is compared: they can let too much through, and never lose a repeat.

Which texts and places are indexed and probed at all is decided by repeated
seeds (seeds.py); the rest can hold no repeated window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholium.llm import seeds
from scholium.llm.common import written

WINDOW, BLOCK, GRAM = 50, 25, 10


def _spread(places: np.ndarray, n: int, before: int, after: int) -> np.ndarray:
    """Which of n places lie from ``before`` ahead of a place to ``after`` behind it."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.maximum(places - before, 0), 1)
    np.add.at(edges, np.minimum(places + after + 1, n), -1)
    return np.cumsum(edges[:-1]) > 0


def _texts(batch: pa.RecordBatch):
    for a, b in zip(batch.column("text").cast(pa.binary()), batch.column("places"), strict=True):
        yield a.as_py(), np.array(b.values, np.int64)


def _probes(window: int, block: int, gram: int):
    def rows(batches):
        for batch in batches:
            out, owner = [], []
            for k, (raw, places) in enumerate(_texts(batch)):
                symbols, _ = seeds.symbols_of([raw], True)
                n = len(symbols) - window + 1
                starts = _spread(places, n, window - gram, 0)  # windows that hold a repeated seed
                at = np.flatnonzero(_spread(np.flatnonzero(starts), len(symbols) - block + 1, 0, window - block))
                out.append((at, seeds.rolling(symbols, block)[at].view(np.int64)))
                owner.append(np.full(len(at), k))
            if not out:
                continue
            owner = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x for _, x in out])), batch.column("did").take(owner), batch.column("th").take(owner), pa.array(np.concatenate([x for x, _ in out]).astype(np.int32))],
                ["block", "did", "th", "place"])

    return rows


def digest(window: bytes | memoryview) -> bytes:
    """What windows are compared by: the first 128 bits of the SHA-256 of the words, joined by spaces."""
    return hashlib.sha256(window).digest()[:16]


def _windows(window: int, block: int):
    """Windows around hits: the digest of the words as two integers, and the place."""

    def rows(batches):
        for batch in batches:
            out, owner = [], []
            for k, (raw, places) in enumerate(_texts(batch)):
                words = raw.split()
                at = np.flatnonzero(_spread(places, len(words) - window + 1, window - block, 0))
                ends = np.cumsum([len(w) + 1 for w in words])
                joined, first = memoryview(b" ".join(words)), np.concatenate([[0], ends[:-1]])[at].tolist()
                found = b"".join([digest(joined[i:j]) for i, j in zip(first, (ends[at + window - 1] - 1).tolist(), strict=True)])
                out.append((at, np.frombuffer(found, "<i8").reshape(-1, 2)))
                owner.append(np.full(len(at), k))
            if not out:
                continue
            owner = pa.array(np.concatenate(owner))
            found = np.concatenate([x for _, x in out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), batch.column("did").take(owner), batch.column("th").take(owner), pa.array(np.concatenate([x for x, _ in out]).astype(np.int32))],
                ["w1", "w2", "did", "th", "place"])

    return rows


def _cut(window: int):
    """What is left of a text without the windows that start at its places."""

    def rows(batches):
        for batch in batches:
            removed, kept = [], []
            for raw, places in _texts(batch):
                words = raw.split()
                gone = _spread(places, len(words), 0, window - 1)
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["did", "th", "removed", "left"])

    return rows


def _facts(raw: bytes) -> tuple[int, str]:
    words = raw.split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of ``docs``.

    A null text has no words. A null doc_id is larger than all others, and rows
    of one doc_id never remove each other's words. Texts of fewer than
    ``window`` words keep all. Other columns are not looked at. An empty table
    gives no rows.
    """
    if not 2 * block <= window:
        raise ValueError("a window must hold a whole block wherever it starts")
    rows = seeds.scan(docs, _facts, True, window, gram)
    reps = seeds.representatives(rows)
    texts = seeds.repeated(docs, rows, reps, other_text=True)
    probes = written(texts.select("did", "th", "text", "places").mapInArrow(_probes(window, block, gram), "block long, did long, th long, place int"), "probes")
    indexed = F.when(F.col("place") % block == 0, F.col("did"))
    met = probes.groupBy("block").agg(F.min(indexed).alias("first"), F.max("did").alias("last")).where("first < last")
    met = written(met, "met-blocks")
    hits = probes.join(met, "block").where((F.col("did") > F.col("first")) | (F.col("place") % block == 0))
    hits = hits.groupBy("did", "th").agg(F.collect_set("place").alias("places"))
    around = texts.select("did", "th", "text").join(hits, ["did", "th"]).select("did", "th", "text", "places")
    windows = written(around.mapInArrow(_windows(window, block), "w1 long, w2 long, did long, th long, place int"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last").select("w1", "w2", "first")
    first = written(first, "first-windows")  # so that Spark can split the join of a hot window
    gone = windows.join(first, ["w1", "w2"]).where("did > first").groupBy("did", "th").agg(F.collect_set("place").alias("places"))
    cut = texts.select("did", "th", "text").join(gone, ["did", "th"]).select("did", "th", "text", "places").mapInArrow(_cut(window), "did long, th long, removed long, left string")
    cut = written(cut.distinct(), "cut-texts")
    names = reps.select("sha", F.col("did").alias("first_did"))
    every = rows.select("did", "th", "sha", "n", "kept").join(names, "sha").join(cut, ["did", "th"], "left")
    whole = (F.col("did") > F.col("first_did")) & (F.col("n") >= window)
    return every.select(
        F.when(F.col("did") != seeds.NO_ID, F.col("did")).alias("doc_id"), F.col("n").alias("n_words"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left", "kept")).alias("kept_sha256"))
