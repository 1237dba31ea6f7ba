"""Exact, near, substring and suffix deduplication against plain versions."""

import hashlib
import os
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from scholium.llm import components, exact_dedup, simhash, substring_dedup, suffix_dedup

SEP = b" \t\n\x0b\x0c\r"


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def words(text):
    return text.encode().split()


@pytest.mark.parametrize("options", [{}, {"block_bytes": 7}, {"block_bytes": 16, "bits": 2}])
def test_exact_groups(docs, odd, options):
    for df in (docs, odd):
        rows = rows_of(df)
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        want = Counter((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
        got = exact_dedup.exact_groups(df, **options).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_copies_go_and_columns_stay(odd, none):
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns
    assert sorted((r.text or "") for r in left.collect()) == sorted({r.text or "" for r in odd.collect()})
    assert exact_dedup.exact_groups(none).count() == 0


def plain_fingerprint(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("node_rows", [50_000, 2])
def test_near_duplicates(spark, docs, odd, node_rows):
    near = docs.limit(60).selectExpr("doc_id + 1000 as doc_id", "concat(text, ' ending') as text", "lang", "source", "n_chars")
    for df in (docs.unionByName(near), odd):
        rows = rows_of(df)
        fps = [plain_fingerprint(t) for _, t in rows]
        parent = list(range(len(rows)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    parent[root(i)] = root(j)
        least = defaultdict(list)
        for i, (doc, _) in enumerate(rows):
            least[root(i)].append(doc)
        want = Counter((doc, f"{fps[i]:016x}", min((x for x in least[root(i)] if x is not None), default=None)) for i, (doc, _) in enumerate(rows))
        assert Counter(map(tuple, simhash.near_duplicates(df, node_rows).collect())) == want


def test_trie_traversal_finds_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    v = [base]
    for k in range(1, 7):
        x = rng.choice(base, 40)
        for _ in range(k):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))
        v.append(x)
    v = np.unique(np.concatenate(v))
    i, j = simhash.traverse(v, np.array([[0, 0, len(v), 0, len(v), 0]]))
    a, b = np.nonzero(np.unpackbits((v[:, None] ^ v[None, :]).view(np.uint8).reshape(len(v), len(v), 8), axis=2).sum(2) <= 3)
    assert (simhash._forest(len(v), i, j) == simhash._forest(len(v), a, b)).all()


def test_near_copies_go(odd, none):
    left = simhash.drop_near_copies(odd)
    assert left.columns == odd.columns and Counter(r.doc_id for r in left.collect())[2] == 0
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as u", "id + 1 as v").union(spark.createDataFrame([(500, 501), (501, 501)], "u long, v long"))
    got = dict(map(tuple, components.components(edges).collect()))
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def plain_word_removal(rows, n=50):
    first, big = {}, 1 << 63
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, t in rows:
        w, mine = words(t), big if i is None else i
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < mine:
                gone[s : s + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def test_substring_removal(docs, odd, none):
    for df in (docs, odd):
        assert Counter(map(tuple, substring_dedup.remove_repeats(df).collect())) == plain_word_removal(rows_of(df))
    assert substring_dedup.remove_repeats(none).count() == 0


def mirrored_words():
    """Two words of 1,024 letters that polynomial hashes modulo 2**64 do not tell apart."""
    bits = [i.bit_count() & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_unlike_words_of_one_polynomial_hash_stay(spark):
    lead = " ".join(f"word{i}" for i in range(49))
    df = spark.createDataFrame([(i, f"{lead} {w}") for i, w in enumerate(mirrored_words())] + [(2, f"{mirrored_words()[1]} {lead}")], "doc_id long, text string")
    assert Counter(map(tuple, substring_dedup.remove_repeats(df).collect())) == plain_word_removal(rows_of(df))
    assert {r.n_removed for r in substring_dedup.remove_repeats(df).collect()} == {0}


def test_unlike_bytes_of_one_polynomial_hash_stay(spark):
    a, b = mirrored_words()
    df = spark.createDataFrame([(i, t) for i, t in enumerate((a, b, a[:700] + "x", "lead " + b))], "doc_id long, text string")
    want = plain_byte_removal([(i, t.encode()) for i, t in rows_of(df)])
    for options in ({}, {"seed_bytes": 500}):
        assert Counter(map(tuple, suffix_dedup.remove_repeated_bytes(df, **options).collect())) == want


def test_whole_table_like_plain_versions(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = rows_of(df)
    assert Counter(map(tuple, substring_dedup.remove_repeats(df).collect())) == plain_word_removal(rows)
    want = plain_byte_removal([(i, t.encode()) for i, t in rows])
    for options in ({}, {"seed_bytes": 3000}):
        assert Counter(map(tuple, suffix_dedup.remove_repeated_bytes(df, **options).collect())) == want


def plain_byte_removal(rows, n=400):
    count = Counter(t[s : s + n] for _, t in rows for s in range(len(t) - n + 1))
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for s in range(len(t) - n + 1):
            if count[t[s : s + n]] > 1:
                gone[s : s + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"seed_bytes": 700}, {"shard_bytes": 2000}])
def test_byte_removal(docs, odd, none, options):
    for df in (docs.where("length(text) < 8000"), odd):
        want = plain_byte_removal([(i, t.encode()) for i, t in rows_of(df)])
        assert Counter(map(tuple, suffix_dedup.remove_repeated_bytes(df, **options).collect())) == want
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60)).astype(np.int16)
        order, n = suffix_dedup.suffix_array(s, 257), len(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s.tolist()[i:])
        common = suffix_dedup.permuted_lcp(s, order)
        for a, b in zip(order[:-1], order[1:], strict=True):
            same = 0
            while max(a, b) + same < n and s[a + same] == s[b + same]:
                same += 1
            assert common[b] == same


def test_only_asked_nodes_are_gathered(spark):
    rows = spark.range(5000).select(F.lit(0).alias("t"), F.col("id").alias("value")).union(spark.createDataFrame([(0, (7 << 40) + i) for i in range(3)], "t int, value long"))
    items = spark.createDataFrame([(0, 7, 7)], "t int, a long, b long")
    assert [(r.node, len(r["values"])) for r in simhash._gathered(items, rows, 24).collect()] == [(7, 3)]


def fragment_peak(size, pattern, with_bytes, path):
    """Memory that cutting the fragments of a long run takes beyond the text's own pass, in MB, and the rows made; in a process of its own."""
    code = f"""
import resource, sys
import numpy as np, pyarrow as pa
from scholium.llm import seeds, suffix_dedup as S
raw = ({pattern!r} * {size})[:{size}]
[(grams, places)] = seeds.seeds([raw.encode()], False, S.WINDOW, S.GRAM)
del grams
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([raw]), pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.array(places.astype(np.int32))), pa.array([1])], ["did", "th", "text", "places", "copies"])
list(S._pieces(raw.encode(), places.astype(np.int64)[:1], S.WINDOW, S.GRAM, 1))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for b in S._fragments(S.WINDOW, S.GRAM, 1, {with_bytes})(iter([batch])))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    return map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": path}).stdout.split())


def test_long_runs_take_little_memory():
    path = str(Path(suffix_dedup.__file__).parents[2])
    for pattern in ("=", "abc"):
        n, mb = fragment_peak(2 << 20, pattern, True, path)
        assert n < 20 and mb < 150
    n, mb = fragment_peak(2 << 20, "=", False, path)
    assert n > 2_000_000 and mb < 150


def test_long_runs(spark):
    texts = ["=" * 30_000, "abc" * 9_000 + " tail", "x" * 450, "no run " + "=" * 399, "-" * 401]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(map(tuple, suffix_dedup.remove_repeated_bytes(df).collect())) == plain_byte_removal([(i, t.encode()) for i, t in enumerate(texts)])
