"""Approximate cosine search: vectors in lists around centroids, of which a question looks into the nearest.

Centroids are fitted on a bounded sample, every vector is put into its nearest
list, and a question's lists are scored exactly. How many it looks into is found
out on the sample, by what its own nearest vectors need. A question that finds fewer
than k (its tenant has few vectors there) looks into twice as many lists, until it
has k or has seen all. ``vector.cosine_top_k`` is the exact way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from scholium.operators.lexical import top_k
from scholium.operators.vector import _matrix, _nearest
from scholium.store import small, written

#: Vectors that centroids are fitted on at most, rounds of fitting, and most lists.
SAMPLE, ROUNDS, MOST_LISTS = 20_000, 12, 1024
#: Sampled vectors that serve as trial questions, and the share of their nearest ones that the lists looked into have to hold.
TRIALS, TARGET = 256, 0.97
#: Vectors of a list that meet its questions at a time; a larger list is spread over tasks.
SLICE = 16_384
#: Rows that a task makes at a time where rows are repeated for each of their lists.
REPEATED = 16_384


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def centroids(vectors: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of spherical k-means; a list that loses all its vectors starts anew at one that is far from its own."""
    rng = np.random.default_rng(seed)
    points = unit(vectors.astype(np.float64))
    centres = points[np.sort(rng.choice(len(points), n, replace=False))]
    for _ in range(rounds):
        near = points @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        empty = np.flatnonzero(np.bincount(own, minlength=n) == 0)
        sums[empty] = points[np.argsort(near.max(axis=1))[: len(empty)]]
        centres = unit(sums)
    return centres


def probes_needed(vectors: np.ndarray, centres: np.ndarray, k: int = 20, target: float = TARGET, trials: int = TRIALS) -> int:
    """How many lists a question has to look into, so that they hold the share ``target`` of its k nearest: by trial on some of the sample.

    In all data the nearest ones are nearer than in a sample, so this errs on the safe side.
    """
    points = unit(vectors.astype(np.float64))
    asked = points[:: max(1, len(points) // trials)]
    near = asked @ points.T
    near[near > 1 - 1e-9] = -2  # the question itself and its copies
    best = np.argsort(-near, axis=1)[:, : min(k, len(points))]
    own = (points @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(target * len(needed)))]) + 1


def closest(batches, centres: np.ndarray, many: int, columns: list[str]):
    """Rows of ``columns`` with list, once for each of their ``many`` nearest lists, at most about ``REPEATED`` at a time: there may be a thousand lists."""
    step = max(1, REPEATED // many)
    for pdf in batches:
        for at in range(0, len(pdf), step):
            rows = pdf.iloc[at : at + step].reset_index(drop=True)
            near = unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64)) @ centres.T
            lists = np.argsort(-near, axis=1, kind="stable")[:, :many]
            yield rows.loc[rows.index.repeat(lists.shape[1]), columns].assign(list=lists.ravel())


@dataclass
class Lists:
    """Every vector ([tenant_id,] vec_id, embedding) with its list and slice, and how many slices a list has."""

    vectors: DataFrame
    slices: DataFrame
    centres: np.ndarray
    by_tenant: bool
    probes: int

    def nearest(self, rows: DataFrame, many: int, columns: list[str]) -> DataFrame:
        """``rows`` with list, once for each of their ``many`` nearest lists."""
        sent = rows.sparkSession.sparkContext.broadcast(self.centres)  # at most MOST_LISTS rows
        schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

        return rows.select(columns).mapInPandas(lambda batches: closest(batches, sent.value, many, columns), f"{schema}, list long")

    def search(self, questions: DataFrame, k: int = 20, probes: int | None = None) -> DataFrame:
        """query_id, vec_id, score, rank of questions (query_id, embedding[, tenant_id]); ties by id, zero vectors match nothing."""
        keys = ["tenant_id"] if self.by_tenant else []
        open_ = written(questions.select(*keys, "query_id", "embedding").where("embedding is not null"), "ann-asked")
        done, probes = None, probes or self.probes
        while True:
            many = min(probes, len(self.centres))
            probed = self.nearest(open_, many, [*keys, "query_id", "embedding"]).join(small(self.slices), "list").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1))).drop("n_slices")
            on = [*keys, "list", "slice"]

            def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
                out = list(_nearest(_matrix(a), b, k)) if len(a) and len(b) else []
                return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

            best = probed.groupBy(*on).cogroup(self.vectors.groupBy(*on)).applyInPandas(meet, "query_id long, vec_id long, score double")
            found = written(top_k(best, ["query_id"], [F.desc("score"), F.asc("vec_id")], k), "ann-found")
            if many == len(self.centres):
                return found if done is None else done.unionByName(found)
            full = written(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id"), "ann-full")
            ready = found.join(small(full), "query_id", "left_semi")
            done = ready if done is None else done.unionByName(ready)
            open_ = written(open_.join(small(full), "query_id", "left_anti"), "ann-asked")
            if open_.isEmpty():
                return done
            probes *= 2


def fitted(vectors: DataFrame, by_tenant: bool = False, sample: int = SAMPLE, most_lists: int = MOST_LISTS, slice_rows: int = SLICE) -> Lists:
    """Lists over ``vectors`` (vec_id, embedding[, tenant_id]), about as many as the root of their number.

    The driver gets at most about ``sample`` vectors, drawn by a hash of their id, to
    fit centroids on; every vector is assigned. Vectors that are null or zero match
    nothing and are left out.
    """
    keys = ["tenant_id"] if by_tenant else []
    rows = vectors.select(*keys, "vec_id", "embedding").where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    n = rows.count()
    share = min(1.0, sample / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding").toPandas()
    fitted_on = np.stack(drawn["embedding"].to_numpy()) if len(drawn) else np.zeros((1, 1))
    centres = centroids(fitted_on, max(1, min(most_lists, int(n**0.5), len(fitted_on))))
    lists = Lists(rows, None, centres, by_tenant, probes_needed(fitted_on, centres))
    if not n:
        lists.slices = rows.sparkSession.createDataFrame([], "list long, n_slices int")
        lists.vectors = rows.withColumn("list", F.lit(0).cast("long")).withColumn("slice", F.lit(0))
        return lists
    own = written(lists.nearest(rows, 1, [*keys, "vec_id", "embedding"]), "ann-lists")
    lists.slices = written(own.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("n_slices")), "ann-slices")
    lists.vectors = written(own.join(small(lists.slices), "list").withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("n_slices")).cast("int")).drop("n_slices"), "ann-vectors")
    return lists
