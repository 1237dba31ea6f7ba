"""Embeddings by feature hashing, and exact cosine search for batches of questions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from scholium.operators.lexical import top_k

#: Questions, and bytes of their vectors, up to which they are sent to the executors whole.
BROADCAST_QUESTIONS, BROADCAST_BYTES = 10_000, 64 << 20
#: Cells of a matrix product of questions sent whole and a slice of vectors.
CELLS = 1 << 20


def hash_embedding(dim: int = 384):
    """Tokens to a unit vector: each token adds a sign at a place drawn from its BLAKE2b-8 digest; no tokens, zero vector."""

    @F.arrow_udf("array<double>")
    def embed(tokens: pa.Array) -> pa.Array:
        words, n = tokens.flatten().dictionary_encode(), len(tokens)
        digests = [hashlib.blake2b(t.encode(), digest_size=8).digest() for t in words.dictionary.to_pylist()]
        place = np.array([int.from_bytes(d[:4], "big") % dim for d in digests], dtype=np.int64)
        sign = np.array([1.0 if d[4] & 1 else -1.0 for d in digests])
        row, at = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()), words.indices.to_numpy()
        out = np.bincount(row * dim + place[at], weights=sign[at], minlength=n * dim).reshape(n, dim)
        size = np.sqrt(np.einsum("ij,ij->i", out, out))
        np.divide(out, size[:, None], out=out, where=size[:, None] > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(out.ravel()))

    return embed


def checked(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Fails where a vector has another length."""
    ok = F.assert_true(F.size(column) == dim, F.lit(f"vectors must have {dim} values"))
    return df.where(ok.isNull())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _nearest(asked: tuple[list, np.ndarray], vectors: pd.DataFrame, k: int):
    """The k best of some vectors for each question, by one matrix product."""
    (ids, q), v, own = asked, np.stack(vectors["embedding"].to_numpy()).astype(np.float64), vectors["vec_id"].to_numpy()
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
    cos = np.round(np.divide(q @ v.T, norms, out=np.full(norms.shape, np.nan), where=norms > 0), 6)
    for x, row in zip(ids, cos, strict=True):
        order = np.lexsort((own, -row))[:k]
        order = order[~np.isnan(row[order])]
        yield pd.DataFrame({"query_id": x, "vec_id": own[order], "score": row[order]})


def _matrix(questions: pd.DataFrame) -> tuple[list, np.ndarray]:
    return questions["query_id"].tolist(), np.stack(questions["embedding"].to_numpy()).astype(np.float64)


class _Best:
    """The k best vectors of each question among all slices so far, which are compared one after the other."""

    def __init__(self, ids: list, questions: np.ndarray, k: int):
        self.ids, self.q, self.k = np.array(ids), questions, k
        self.norms, self.floor = np.linalg.norm(questions, axis=1), np.full(len(ids), -np.inf)
        self.at, self.own, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, own: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, CELLS // len(self.ids))
        for i in range(0, len(own), step):
            self._slice(own[i : i + step], vectors[i : i + step].astype(np.float64))

    def _slice(self, own: np.ndarray, v: np.ndarray) -> None:
        norms = self.norms[:, None] * np.linalg.norm(v, axis=1)[None, :]
        cos = np.round(np.divide(self.q @ v.T, norms, out=np.full(norms.shape, np.nan), where=norms > 0), 6)
        row, col = np.nonzero(cos >= self.floor[:, None])
        at, own, score = np.concatenate([self.at, row]), np.concatenate([self.own, own[col]]), np.concatenate([self.score, cos[row, col]])
        order = np.lexsort((own, -score, at))
        first = np.searchsorted(at[order], np.arange(len(self.ids)))
        order = order[np.arange(len(order)) - first[at[order]] < self.k]
        self.at, self.own, self.score = at[order], own[order], score[order]
        last = np.searchsorted(self.at, np.arange(len(self.ids)), side="right") - 1
        full = np.bincount(self.at, minlength=len(self.ids)) == self.k
        self.floor[full] = self.score[last[full]]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.at], pa.int64()), pa.array(self.own, pa.int64()), pa.array(self.score, pa.float64())], ["query_id", "vec_id", "score"])


def cosine_top_k(questions: DataFrame, vectors: DataFrame, k: int = 20, by_tenant: bool = False, block: int = 256, slice_rows: int = 16_384) -> DataFrame:
    """query_id, vec_id, score, rank: exact cosine, ties by id; zero vectors match nothing.

    ``questions`` (query_id, embedding[, tenant_id]) go against all vectors (those
    of their tenant) as matrix products, of which only the k best a question go on. Questions within ``BROADCAST_QUESTIONS`` and ``BROADCAST_BYTES`` are
    sent to each executor once, and each task keeps the k best a question of all
    its batches, whose matrix products have about ``CELLS`` cells. Beyond, blocks of questions meet slices of vectors
    in groups, of about ``block`` and at most about ``slice_rows`` rows.
    """
    keys = ["tenant_id"] if by_tenant else []
    asked = questions.select(*keys, "query_id", "embedding").where("embedding is not null")
    vectors = vectors.select(*keys, "vec_id", "embedding").where("embedding is not null")
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if n <= BROADCAST_QUESTIONS and 8 * n * width <= BROADCAST_BYTES:
        rows = asked.toPandas()
        parts = rows.groupby("tenant_id", sort=False) if by_tenant else [(None, rows)] if n else []
        sent = questions.sparkSession.sparkContext.broadcast({key: _matrix(part) for key, part in parts})

        def score(batches):
            best: dict = {}
            for batch in batches:
                owners = np.array(batch.column("tenant_id").to_pylist() if by_tenant else [None] * len(batch), dtype=object)
                for key in {*owners} & sent.value.keys():
                    group = batch.filter(pa.array(owners == key))
                    v = group.column("embedding")
                    if key not in best:
                        best[key] = _Best(*sent.value[key], k)
                    state = best[key]
                    if pc.any(pc.not_equal(pc.list_value_length(v), state.q.shape[1])).as_py():
                        raise ValueError("vectors and questions must have one length")
                    state.add(group.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1))
            for state in best.values():
                yield state.rows()

        best = vectors.mapInArrow(score, "query_id long, vec_id long, score double")
    else:
        blocks, slices = -(-n // block), max(1, -(-vectors.count() // slice_rows))
        on = [*keys, "part", "slice"]
        own, every = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)), lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
        left = asked.withColumn("part", own("query_id", blocks)).withColumn("slice", every(slices))
        right = vectors.withColumn("slice", own("vec_id", slices)).withColumn("part", every(blocks))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = list(_nearest(_matrix(a), b, k)) if len(a) and len(b) else []
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

        best = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(meet, "query_id long, vec_id long, score double")
    return top_k(best, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
