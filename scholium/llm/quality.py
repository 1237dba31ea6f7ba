"""Quality rules as a short-circuit cascade.

A rule rejects a text by a few facts about it. On a sample, each rule's cost
(seconds) and rejections are measured by itself; the rules then run in order of
rejections per second, and a text that one rejects is shown to no other. The
order changes the time, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of the sample that costs and rejections are measured on, about.
SAMPLE_ROWS = 2000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: ASCII white space of the contract; bytes.split() and bytes.strip() know just these.
SPACES = b" \t\n\x0b\x0c\r"
#: Odd multipliers that fold the words of a window into 64 bits.
_MIX = (np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a window of 8 words that the text has at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    spread ^= spread >> np.uint64(32)
    keys = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        keys += spread[i : i + n] * _MIX[i]
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)  # candidates by 64 bits; the words themselves decide
    _, inverse, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[at], axis=0, return_inverse=True, return_counts=True)
    at = at[counts[inverse.ravel()] > 1]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


class Facts:
    """Facts about a UTF-8 text, each worked out when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, SPACES).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)


def too_short(x: Facts) -> bool:
    return x.n_words < 20


def too_repetitive(x: Facts) -> bool:
    return 100 * x.n_repeat_words > 30 * x.n_words


def too_many_symbols(x: Facts) -> bool:
    return 100 * x.n_symbols > 20 * x.n_words


def too_many_copied_lines(x: Facts) -> bool:
    return x.n_dup_lines >= 3 and 100 * x.n_dup_lines > 30 * len(x.lines)


def odd_words(x: Facts) -> bool:
    return not 2 * x.n_words <= x.word_chars <= 20 * x.n_words


def stuttering(x: Facts) -> bool:
    return 100 * sum(map(bytes.__eq__, x.words, x.words[1:])) > 30 * x.n_words


RULES = (too_short, too_repetitive, too_many_symbols, too_many_copied_lines, odd_words, stuttering)
BASE = (too_short, too_repetitive)


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def rule_order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[str]:
    """Names of the rules, best rejections per second first."""
    sample = docs.select("text").sample(fraction=min(1.0, sample_rows / max(docs.count(), 1)), seed=seed)

    def measure(batches):
        for batch in batches:
            rows = []
            for raw in _raw(batch):
                for rule in rules:
                    began = time.perf_counter()
                    rejected = rule(Facts(raw))
                    rows.append((rule.__name__, time.perf_counter() - began, int(rejected)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64()))], ["rule", "seconds", "rejected"])

    found = sample.mapInArrow(measure, "rule string, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).collect()
    gain = {x["rule"]: x["r"] / max(x["s"], 1e-9) for x in found}
    return sorted((r.__name__ for r in rules), key=lambda x: (-gain.get(x, 0.0), x))


def _verdict(facts: Facts, ordered) -> bool:
    return not any(rule(facts) for rule in ordered)


def score(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    One row per row of ``docs``. A null text has no words, so it fails the base
    rules; null or repeated doc_ids and repeated rows are judged one by one. An
    empty table gives no rows.
    """
    by_name = {r.__name__: r for r in rules}
    ordered = [by_name[x] for x in rule_order(docs, rules)]

    def facts(batches):
        for batch in batches:
            rows = []
            for raw in _raw(batch):
                x = Facts(raw)
                kept, failed = _verdict(x, ordered), any(rule(x) for rule in BASE)
                rows.append((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, kept and not failed))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:])],
                                             ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(facts, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that no rule rejects.

    A null or empty text has too few words and goes; null and repeated doc_ids
    and repeated rows are judged one by one. An empty table gives no rows.
    """
    by_name = {r.__name__: r for r in rules}
    ordered = [by_name[x] for x in rule_order(docs, rules)]

    def passing(batches):
        for batch in batches:
            yield batch.filter(pa.array([_verdict(Facts(raw), ordered) for raw in _raw(batch)], pa.bool_()))

    return docs.mapInArrow(passing, docs.schema)
