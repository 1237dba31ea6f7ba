"""Approximate search against the exact one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scholium.operators import ann, vector
from scholium.queries import retrieval as queries

D = "/root/testdata/sf0.01"


def recall(exact, found):
    want, got = ({(r.query_id, r.vec_id) for r in df.collect()} for df in (exact, found))
    return len(want & got) / len(want)


def test_recall(spark):
    assert recall(queries.cosine_topk(spark, D), queries.ann_topk(spark, D)) >= 0.9
    assert recall(queries.cosine_topk_tenant(spark, D), queries.ann_topk_tenant(spark, D)) >= 0.9


def test_small_tenants_get_all_they_have(spark):
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 5, "few").otherwise("many").alias("tenant_id"), F.array(*(F.sin((F.col("id") + 1) * (i + 1)) for i in range(8))).alias("embedding"))
    rows = rows.unionByName(spark.createDataFrame([(900, "few", None), (901, "few", [0.0] * 8)], "vec_id long, tenant_id string, embedding array<double>")).cache()
    lists = ann.fitted(rows, by_tenant=True, slice_rows=20)
    assert lists.vectors.count() == 400 and lists.vectors.select("slice").distinct().count() > 1
    asked = rows.where("vec_id in (1, 2, 300, 900)").select(F.col("vec_id").alias("query_id"), "tenant_id", "embedding")
    exact = vector.cosine_top_k(asked, rows, 6, by_tenant=True)
    everything = lambda df, who: sorted(tuple(r) for r in df.where(who).select("query_id", "vec_id", "score", "rank").collect())
    got = lists.search(asked, 6, probes=1)
    assert everything(got, "query_id < 10") == everything(exact, "query_id < 10") and got.where("query_id = 300").count() == 6
    assert everything(lists.search(asked, 6, probes=1000), "true") == everything(exact, "true")  # all lists: exact


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.5])], "query_id long, embedding array<double>")
    assert ann.fitted(rows).search(asked, 2).count() == min(n, 2)


def test_repeated_rows_come_in_pieces(monkeypatch):
    """A question that looks into many lists is repeated for each: not a whole batch of them at once."""
    monkeypatch.setattr(ann, "REPEATED", 100)
    rng = np.random.default_rng(3)
    centres, rows = rng.normal(size=(40, 8)), pd.DataFrame({"vec_id": range(30), "embedding": list(rng.normal(size=(30, 8)))}, index=range(5, 35))
    got = list(ann.closest([rows, rows[:0]], centres, 25, ["vec_id", "embedding"]))
    assert max(map(len, got)) <= 100 and sum(map(len, got)) == 30 * 25
    near = np.argsort(-(ann.unit(np.stack(rows["embedding"])) @ centres.T), axis=1, kind="stable")[:, :25]
    assert np.array_equal(pd.concat(got)["list"].to_numpy(), near.ravel()) and pd.concat(got)["vec_id"].tolist() == np.repeat(range(30), 25).tolist()
