"""Canonical texts against the standard library's JSON."""

import hashlib
import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F, types as T

from scholium.functions import canonical as K


def dumped(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"))


def test_doubles(spark):
    rng = random.Random(7)
    bits = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    near = [rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-8, 20) for _ in range(3000)]
    plain = [0.0, -0.0, 0.1, 1.2, 0.75, 1e-4, 1e-5, 9.999e-5, 1e15, 1e16, 123456789012345680.0, 2e23, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), -8.0, 1 / 3, 2.0e-3]
    xs = [x for x in plain + near + bits if x == x]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r.t for r in rows.select("i", K.canonical(F.col("x"), T.DoubleType()).alias("t")).collect()}
    digits = lambda x: len(re.sub("e.*|[^0-9]", "", dumped(x)).strip("0"))
    assert [(x, got[i]) for i, x in enumerate(xs) if got[i] != dumped(x) and digits(x) < 17] == []
    odd = [(x, got[i]) for i, x in enumerate(xs) if got[i] != dumped(x)]
    assert len(odd) < 10 and all(json.loads(t) == x for x, t in odd)


def test_doubles_of_a_batch_and_within_arrays(spark):
    """A field's double has the digits of the standard library, seventeen too; within an array it stays a column expression."""
    rng = random.Random(11)
    xs = [rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-12, 20) for _ in range(2000)] + [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, None, 2e-44, 2.0**-44, 1e23, 2.2250738585072014e-308]
    rows = spark.createDataFrame([(i, (x,), [None if x is None else 0.25]) for i, x in enumerate(xs * 2)], "i int, x struct<v:double>, a array<double>")
    made = rows.select("i", K.canonical(F.struct("x", "a"), rows.select("x", "a").schema).alias("t"))
    assert {r.i: r.t for r in made.collect()} == {i: dumped({"x": {"v": x}, "a": [None if x is None else 0.25]}) for i, x in enumerate(xs * 2)}
    narrow = spark.createDataFrame([(0.5,), (None,)], "x float").select(K.canonical(F.col("x"), T.FloatType()))
    assert [r[0] for r in narrow.collect()] == ["0.5", "null"]


def test_texts(spark):
    texts = ["", "plain", 'a "quote" \\ back', "tab\tline\nfeed\rform\fback\b", "\x00\x01\x1f\x7f", "naïve – “x” € 漢字 😀  ", "😀", None, "$1 \\u0041"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.j for r in rows.select("i", K.canonical(F.col("t"), T.StringType()).alias("j")).collect()}
    assert [got[i] for i in range(len(texts))] == [dumped(t) for t in texts]


def test_nested(spark):
    kind = "b struct<z:int,a:array<struct<y:boolean,x:double>>>, a map<string,array<string>>, c long"
    values = [
        {"b": {"z": 1, "a": [{"y": True, "x": 0.5}, None, {"y": None, "x": 1e-7}]}, "a": {"é": ["x", None], "B": [], "a": None}, "c": -5},
        {"b": None, "a": {}, "c": None},
        {"b": {"z": None, "a": []}, "a": None, "c": 2**62},
    ]
    rows = spark.createDataFrame([(v["b"] and (v["b"]["z"], [x and (x["y"], x["x"]) for x in v["b"]["a"]]), v["a"], v["c"]) for v in values], kind)
    got = [r[0] for r in rows.select(K.canonical(F.struct("c", "b", "a"), rows.select("c", "b", "a").schema)).collect()]
    assert got == [dumped(v) for v in values]


def test_whole_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kind = rows.schema
    got = {r.doc_id: r.v for r in rows.select("doc_id", K.version(K.canonical(F.struct("*"), kind)).alias("v")).collect()}
    want = {r.doc_id: hashlib.sha256(dumped(r.asDict()).encode()).hexdigest()[:12] for r in rows.collect()}
    assert got == want and len(want) > 100


def test_versions_follow_values_not_order(spark):
    one = spark.createDataFrame([(1, 0.5, "m")], "k int, w double, model string")
    same = K.settings_version(one, ["k", "w", "model"]), K.settings_version(one, ["model", "k", "w"])
    a, b, c = one.select(*same, K.settings_version(one, ["k", "w"])).first()
    assert a == b != c and a == hashlib.sha256(b'{"k":1,"model":"m","w":0.5}').hexdigest()[:12]
    sizes = spark.createDataFrame([(512, 64, 32), (512, None, 32)], "max_tokens int, overlap_tokens int, min_tokens int")
    assert [r[0] for r in sizes.select(K.chunking_version()).collect()] == [hashlib.sha256(b"512:64:32").hexdigest()[:12], None]


def test_types_without_a_text_are_refused():
    with pytest.raises(TypeError):
        K.canonical(F.col("x"), T.DateType())
