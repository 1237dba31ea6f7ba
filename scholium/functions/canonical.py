"""One text for a nested value, whatever the order of its keys, and the versions made of it."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The settings that each version covers.
CHUNKING = "max_tokens overlap_tokens min_tokens".split()
RETRIEVAL = (
    "embedding_provider embedding_model embedding_dim retrieval_top_k_per_retriever rrf_k bm25_k1 bm25_b hnsw_ef_search rerank_enabled "
    "reranker_model rerank_top_k rerank_min_score context_token_budget metadata_filtering_enabled").split()
EXTRACTION = "model prompt_version max_chunks max_edges_per_chunk max_edges_per_document cross_course weights llm_confidence_cap auto_accept review_floor".split()
VERSION_DIGITS = 12

_SHORT = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def quoted(text: Column) -> Column:
    """A JSON string in ASCII; characters beyond it as UTF-16 units in lower hex."""
    for raw, mark in _SHORT:
        text = F.replace(text, F.lit(raw), F.lit(mark))
    unit = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    spelt = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.rlike(r"[^\x20-\x7e]"), unit(c)).otherwise(c)), "")
    return _let(text, lambda t: F.concat(F.lit('"'), F.when(t.rlike(r"[^\x20-\x7e]"), spelt(t)).otherwise(t), F.lit('"')))


def shortest(number: Column) -> Column:
    """The shortest decimal that reads back as the same double; an exponent below -4 and from 16 on.

    Where that takes seventeen digits they are the JVM's, whose last may be off by
    one from the nearest; it reads back as the same double all the same.
    """
    own = number.cast("string")
    few = F.length(F.regexp_replace(own, "E.*|[^0-9]", "")) <= 15  # then no other decimal is as short
    usual = F.abs(number).between(1e-3, 1e7 - 1) | (number == 0)
    forms = [F.format_string(f"%.{n}e", number) for n in range(17)]
    same = lambda t: t.cast("double") == number
    first = lambda of: F.get(F.filter(F.array(*of), same), F.lit(0))
    normal = F.coalesce(*(F.when(same(f), f) for f in forms[14:16]), forms[16])
    # of whole numbers the JVM gives digits that are rounded already; a decimal knows all of them
    places = first([F.round(number.cast("long").cast("decimal(20,0)"), -m).cast("string") for m in range(18, -1, -1)])
    whole = _let(places, lambda t: F.concat(F.regexp_replace(t, r"^(-?\d)", "$1."), F.lit("e+"), (F.length(F.regexp_replace(t, "-", "")) - 1).cast("string")))
    tiny = F.regexp_replace(first(forms), r"^(-?\d)e", "$1.0e")
    exact = F.when(F.abs(number) < 1e-300, tiny).when(few & ~usual, F.regexp_replace(F.regexp_replace(own, "E([0-9])", "e+$1"), "E", "e")).when(F.abs(number).between(2.0**53, 2.0**63 - 1024), whole).otherwise(normal)

    def parts(s: Column) -> Column:
        digits = F.regexp_replace(F.concat(F.regexp_extract(s, r"(\d)\.", 1), F.regexp_extract(s, r"\.(\d+)e", 1)), "0+$", "")
        return F.struct(F.regexp_extract(s, "^(-?)", 1).alias("sign"), digits.alias("digits"), F.regexp_extract(s, "e([+-][0-9]+)$", 1).cast("int").alias("e"))

    def plain(p: Column) -> Column:
        digits, e = p["digits"], p["e"]
        tail, fraction, power = F.substring(digits, 2, 17), F.substr(digits, e + 2), F.abs(e).cast("string")
        above = F.concat(F.substr(F.rpad(digits, 17, "0"), F.lit(1), e + 1), F.lit("."), F.when(F.length(fraction) > 0, fraction).otherwise("0"))
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        short = F.concat(F.substring(digits, 1, 1), F.when(F.length(tail) > 0, F.concat(F.lit("."), tail)).otherwise(""), F.when(e < 0, "e-").otherwise("e+"), F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
        return F.concat(p["sign"], F.when(digits == "", "0.0").when((e >= 0) & (e < 16), above).when((e < 0) & (e >= -4), below).otherwise(short))

    named = F.when(F.isnan(number), "NaN").when(number == float("inf"), "Infinity").when(number == float("-inf"), "-Infinity")
    return named.when(few & usual, own).otherwise(_let(_let(exact, parts), plain))


@F.arrow_udf(T.StringType())
def _repr(numbers: pa.Array) -> pa.Array:
    """The shortest decimals of a batch, each distinct double (by its bits) once."""
    found = numbers.view(pa.int64()).dictionary_encode()
    texts = pa.array([json.dumps(x) for x in found.dictionary.view(pa.float64()).to_pylist()], pa.string())
    return texts.take(found.indices)


def canonical(value: Column, kind: T.DataType, inner: bool = False) -> Column:
    """Compact JSON of a value: keys in order of code points, ASCII only, null fields kept.

    Structs, maps with keys of text, arrays, texts, integers, doubles and
    booleans; other types have no text of their own here and are refused. Doubles
    go through Python, those ``inner`` to an array or a map, where no batch is at
    hand, through ``shortest``.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        pairs = [F.concat(F.lit(f"{json.dumps(f.name)}:"), canonical(value[f.name], f.dataType, inner)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        keys = F.array_sort(F.map_keys(value))
        out = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(quoted(k), F.lit(":"), canonical(value[k], kind.valueType, True))), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType, True)), ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        out = quoted(value)
    elif isinstance(kind, (*_INTEGERS, T.BooleanType)):
        out = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _let(value.cast("double"), shortest) if inner else _repr(value.cast("double"))
    else:
        raise TypeError(f"no canonical text of {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def version(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, VERSION_DIGITS)


def chunking_version() -> Column:
    """The version of the three sizes, joined by colons; null where one is unknown."""
    a, b, c = (F.col(name).cast("string") for name in CHUNKING)
    return version(F.concat(a, F.lit(":"), b, F.lit(":"), c))


def settings_version(rows: DataFrame, names: list[str]) -> Column:
    """The version of the named columns of ``rows``, in whatever order they are given."""
    kinds = rows.select(*names).schema
    return version(canonical(F.struct(*names), kinds))
