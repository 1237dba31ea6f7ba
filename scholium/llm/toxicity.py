"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades 0 < 1 < 2 of severity come from the labels: sound, of low quality, toxic. The labels
know no degrees of toxicity; low quality stands between as the grade that such texts are
most often mistaken for. P(grade > k) = sigmoid(x.w - cut_k): all cuts share the weights w. A
text's features x count its words and the stems of longer words. The model is fitted on at
most ``LABEL_ROWS`` labelled rows: Spark counts their words and screens out those
that lean to no grade, the driver gets the rest as numbers,
and an L1 penalty (accelerated proximal gradient) thins the rest. Every document is then scored in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholium.llm.common import text_of, written

#: Labelled rows that the model is fitted on, at most: those of the least hash.
LABEL_ROWS = 10_000
GRADES = 3
#: Words in fewer fitted rows have no weight of their own.
MIN_ROWS = 5
#: Standard deviations by which a word's rows must lean to or from toxic.
LEAN = 4.0
PENALTY = 0.0001
STEPS = 600
#: A document is called toxic from this probability of the top grade on.
TOXIC = 0.5
#: Bytes of a stem.
STEM = 6
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def counts(raw: bytes) -> tuple[Counter, Counter]:
    """How often a text has each word and each stem, without case and ASCII punctuation."""
    words = raw.translate(_SPLIT).split()
    return Counter(words), Counter([w[:STEM] for w in words if len(w) > STEM])


def features(raw: bytes) -> dict[bytes, float]:
    """Words, and stems marked by a star, with log2 of one more than how often the text has each."""
    words, stems = counts(raw)
    return {w: math.log2(n + 1) for w, n in words.items()} | {w + b"*": math.log2(n + 1) for w, n in stems.items()}


@dataclass
class Model:
    weights: dict[bytes, float]
    cuts: tuple[float, ...]

    def __post_init__(self):
        self.stems = {w[:-1]: x for w, x in self.weights.items() if w[-1:] == b"*"}

    def above(self, raw: bytes) -> list[float]:
        """P(grade > k) for each k."""
        words, stems = counts(raw)
        score = sum(self.weights[w] * math.log2(words[w] + 1) for w in sorted(words.keys() & self.weights.keys()))
        score += sum(self.stems[w] * math.log2(stems[w] + 1) for w in sorted(stems.keys() & self.stems.keys()))
        return [float(_sigmoid(np.float64(score - c))) for c in self.cuts]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[list[tuple[int, float]]], grades: list[int], words: list[bytes], n_grades: int = GRADES) -> Model:
    """Fits weights of ``words``; a row lists its words' numbers and values. Grades that no row has leave their cut out of reach."""
    y, top = np.array(grades, np.int64), n_grades - 1
    column = np.array([k for x in rows for k, _ in x], np.int64)
    value = np.array([v for x in rows for _, v in x], np.float64)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows]).astype(np.int64)
    n = max(len(rows), 1)
    w = np.zeros(len(words))
    rate = np.array([((y > k).sum() + 0.5) / (n + 1) for k in range(top)])
    cuts = -np.log(rate / (1 - rate))

    def gradient(w, cuts):
        score = np.bincount(owner, w[column] * value, len(rows)) if len(column) else np.zeros(len(rows))
        above = np.ones((len(rows), n_grades + 1))
        above[:, -1] = 0
        above[:, 1:-1] = _sigmoid(score[:, None] - cuts[None, :])
        slope = above * (1 - above)
        at = np.arange(len(rows))
        p = np.maximum(above[at, y] - above[at, y + 1], 1e-12)
        by_score = -(slope[at, y] - slope[at, y + 1]) / p / n
        by_cut = np.array([((y == k + 1) * slope[:, k + 1] / p - (y == k) * slope[:, k + 1] / p).sum() / n for k in range(top)])
        return np.bincount(column, by_score[owner] * value, len(words)), by_cut

    # steps that never overshoot: each weight's curvature is at most half its entries times their rows' totals
    total = np.bincount(owner, value, len(rows)) + 1
    curve = np.concatenate([np.bincount(column, total[owner] * value, len(words)), np.full(top, total.sum())]) / (2 * n)
    pace = 1.0 / np.maximum(curve, 1e-9)
    keen = np.concatenate([pace[: len(words)] * PENALTY, np.zeros(top)])
    x = np.concatenate([w, cuts])
    ahead, momentum = x, 1.0
    for _ in range(STEPS if len(rows) else 0):
        gw, gc = gradient(ahead[: len(words)], ahead[len(words) :])
        moved = ahead - pace * np.concatenate([gw, gc])
        moved = np.sign(moved) * np.maximum(np.abs(moved) - keen, 0)
        moved[len(words) :] = np.sort(moved[len(words) :])
        if (moved - x) @ (ahead - moved) > 0:  # overshot: start the momentum anew
            momentum = 1.0
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead, x, momentum = moved + (momentum - 1) / following * (moved - x), moved, following
    w, cuts = x[: len(words)], x[len(words) :]
    return Model({k: float(v) for k, v in zip(words, w.tolist(), strict=True) if v}, tuple(cuts.tolist()))


def train(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS) -> Model:
    """A model of the labelled rows with the least hashes of doc_id; unlabelled and unknown ones are left out."""
    grade = F.when(F.col("toxic") > 0, 2).when(F.col("quality") == 0, 1).otherwise(0)
    sample = labels.where("doc_id is not null and toxic is not null").select("doc_id", grade.alias("grade")).orderBy(F.xxhash64("doc_id"), "grade").limit(label_rows)
    sample = written(sample, "labelled")  # at most label_rows rows: small enough to broadcast

    def featured(batches):
        for batch in batches:
            found = [features(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), batch.column("grade"), pa.array([list(x) for x in found], pa.list_(pa.binary())), pa.array([list(x.values()) for x in found], pa.list_(pa.float64()))],
                ["doc_id", "th", "grade", "words", "values"])

    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", F.xxhash64("text").alias("th"), "grade", "text")
    labelled = written(labelled.mapInArrow(featured, "doc_id long, th long, grade int, words array<binary>, values array<double>"), "labelled-texts").dropDuplicates(["doc_id", "th", "grade"])
    chosen = written(labelled.select("doc_id", "th", "grade").orderBy(F.xxhash64("doc_id"), "th", "grade").limit(label_rows), "labelled-chosen")  # repeated doc_ids do not raise the bound
    rows = written(labelled.join(F.broadcast(chosen), ["doc_id", "th", "grade"], "left_semi").select("grade", "words", "values"), "labelled-rows")

    top = F.col("grade") == GRADES - 1
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(top.cast("int")), F.lit(0))).first()
    share = min(max(toxic / n if n else 0.0, 1e-6), 1 - 1e-6)
    by_word = rows.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("held"), F.sum(top.cast("int")).alias("toxic"))
    leaning = (F.col("held") >= MIN_ROWS) & (F.abs(F.col("toxic") - F.col("held") * share) >= LEAN * F.sqrt(F.col("held") * share * (1 - share)))
    words = sorted(bytes(r.word) for r in by_word.where(leaning).select("word").collect())  # the model's own words
    number = {w: i for i, w in enumerate(words)}

    def numbered(batches):
        for batch in batches:
            lists = [sorted((number[w], v) for w, v in zip(ws, vs, strict=True) if w in number) for ws, vs in zip(batch.column("words").to_pylist(), batch.column("values").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), *(pa.array([[x[i] for x in y] for y in lists], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.float64())))], ["grade", "numbers", "values"])

    found = rows.mapInArrow(numbered, "grade int, numbers array<int>, values array<double>").toArrow()  # at most label_rows rows, of screened words alone
    ordered = sorted(zip(*(found[c].to_pylist() for c in ("grade", "numbers", "values")), strict=True))  # in one order, so that reruns agree
    return fit([list(zip(n, v, strict=True)) for _, n, v in ordered], [g for g, _, _ in ordered], words)


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity, grade, toxic: one row per row of ``docs``.

    severity is the expected grade. A null text has no words and gets the grade
    of the cuts alone; null and repeated doc_ids and repeated rows are scored one
    by one. Without labels nothing is toxic. An empty table gives no rows.
    """

    def scored(batches):
        for batch in batches:
            above = [model.above(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([sum(x) for x in above], pa.float64()), pa.array([sum(p >= TOXIC for p in x) for x in above], pa.int32()), pa.array([x[-1] >= TOXIC for x in above], pa.bool_())],
                ["doc_id", "severity", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, severity double, grade int, toxic boolean")
