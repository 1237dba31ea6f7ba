"""Streams: mastery kept up to date, and a rate limit whose window opens at the first hit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholium.operators.learning import HALF_LIFE, W_BEST, W_LATEST, W_MEAN, clip, seconds


def mastery_stream(events: DataFrame) -> DataFrame:
    """user_id, concept_id, mastery, as_of for each learner and concept that a batch touches (update mode).

    Decay is exponential, so the state is five numbers a concept, all decayed to
    the concept's own latest moment; seen from the learner's latest one they only
    shrink by one factor. Events may come in any order.
    """
    rows = events.where("concept_id is not null and occurred_at is not null and weight > 0").select(
        "user_id", "concept_id", clip(F.col("mastery")).alias("value"), F.col("weight").cast("double").alias("weight"), seconds(F.col("occurred_at")).alias("at"))

    def keep(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own: dict[int, list[float]] = {int(c): [at, s, w, b, v] for c, at, s, w, b, v in zip(*state.get, strict=True)} if state.exists else {}
        for pdf in frames:
            for c, value, weight, at in zip(pdf["concept_id"], pdf["value"], pdf["weight"], pdf["at"], strict=True):
                old = own.get(int(c))
                if old is None:
                    own[int(c)] = [at, weight * value, weight, value, value]
                    continue
                now = max(at, old[0])
                a, b = (0.5 ** ((now - x) / 86400 / HALF_LIFE) for x in (old[0], at))
                latest = max(value, old[4]) if at == old[0] else (value if at > old[0] else old[4])
                own[int(c)] = [now, old[1] * a + weight * value * b, old[2] * a + weight * b, max(old[3] * a, value * b), latest]
        state.update(tuple(list(x) for x in zip(*((c, *v) for c, v in own.items()), strict=True)))
        as_of = max(v[0] for v in own.values())
        out = []
        for c, (at, s, w, best, latest) in own.items():
            d = 0.5 ** ((as_of - at) / 86400 / HALF_LIFE)
            out.append((key[0], c, round(min(1.0, max(0.0, W_MEAN * s / w + W_BEST * best * d + W_LATEST * latest * d)), 6), as_of))
        yield pd.DataFrame(out, columns=["user_id", "concept_id", "mastery", "as_of"])

    return rows.groupBy("user_id").applyInPandasWithState(
        keep, "user_id long, concept_id long, mastery double, as_of double", "c array<long>, at array<double>, s array<double>, w array<double>, b array<double>, v array<double>", "update", GroupStateTimeout.NoTimeout)


def fixed_window(hits: list[float], limit: int, window: float, start: float | None = None, count: int = 0):
    """(denied, retry after) of each hit; a window opens at the first hit after the last one closed."""
    out = []
    for at in hits:
        if start is None or at >= start + window:
            start, count = at, 0
        count += 1
        out.append((count > limit, max(0.0, start + window - at) if count > limit else 0.0))
    return out, start, count


def rate_limited(hits: DataFrame, limit: int, window: float) -> DataFrame:
    """key, at, seq, denied, retry_after for a batch of hits (key, at in seconds, seq).

    Batches of sorted rows pass by; only the open window of the key at hand is held.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, count = None, None, 0
        for pdf in frames:
            denied, after = [], []
            for k, at in zip(pdf["key"], pdf["at"], strict=True):
                if k != key:
                    key, start, count = k, None, 0
                marks, start, count = fixed_window([at], limit, window, start, count)
                denied.append(marks[0][0])
                after.append(round(marks[0][1], 6))
            yield pdf.assign(denied=denied, retry_after=after)

    rows = hits.select("key", "at", "seq").repartition("key").sortWithinPartitions("key", "at", "seq")
    return rows.mapInPandas(fold, "key long, at double, seq long, denied boolean, retry_after double")


def rate_limit_stream(hits: DataFrame, limit: int, window: float) -> DataFrame:
    """The same over a stream: the state of a key is its window's start and count."""

    def keep(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(frames)).sort_values(["at", "seq"])
        marks, start, count = fixed_window(pdf["at"].tolist(), limit, window, start, count)
        state.update((start, count))
        yield pdf.assign(denied=[m[0] for m in marks], retry_after=[round(m[1], 6) for m in marks])[["key", "at", "seq", "denied", "retry_after"]]

    return hits.select("key", "at", "seq").groupBy("key").applyInPandasWithState(keep, "key long, at double, seq long, denied boolean, retry_after double", "start double, n long", "append", GroupStateTimeout.NoTimeout)
