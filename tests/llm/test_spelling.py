"""Spelling variants against a plain version that compares every two words."""

import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from scholium.llm import spelling


def plain_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    by_length, near = {}, {w: [] for w in counts}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w in counts:
        near[w] = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if plain_near(w, v)]
    form = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: f for w, f in form.items() if counts[f] >= 10 * counts[w]}
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return out


def as_set(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_documents(odd, none, docs):
    for df in (odd, none, docs.sample(0.15, seed=3)):
        assert as_set(spelling.spelling_variants(df)) == plain_variants(plain_counts([(r.doc_id, r.text) for r in df.collect()]))


def test_counts(docs, odd):
    for df in (docs, odd):
        assert {r.word: r.n for r in spelling.word_counts(df).collect()} == plain_counts([(r.doc_id, r.text) for r in df.collect()])


def table(spark, counts):
    return spark.createDataFrame(sorted(counts.items()), "word string, n long")


def test_chains_ties_and_long_words(spark):
    counts = {"aaaaaaa": 1_000_000, "aaaaaaab": 10_000, "aaaaaabb": 500, "aaaaabbb": 40, "aaaabbbb": 4, "zaaaaaaa": 10_000, "éaaaaaa": 7, "abcdefg": 10, "abcdefh": 100, "abcdefi": 100, "bcdefgh": 5}
    long = "x" * 60 + "y" * 68
    counts |= {long: 900, long[:-1]: 9, long + "z": 80, "w" + long[1:]: 7, long[:70] + "é" + long[71:]: 90, "q" + long + "z": 3, long[:127]: 9, long * 3: 50, long * 3 + "a": 5, (long * 3)[1:]: 2}
    for letter in "abcdefghijklmnopqrstuvwx":
        counts["hot" + letter + "words"] = ord(letter)
        counts[long[:50] + letter + long[51:] + "zz"] = ord(letter)
    assert as_set(spelling.variants(table(spark, counts))) == plain_variants(counts)


def test_very_long_runs(spark):
    run = "ab" * 60_000
    df = spark.createDataFrame([(1, f"{run} {run} {run}c {run}c short short shorter shorter")], "doc_id long, text string")
    got = as_set(spelling.spelling_variants(df))
    want = plain_counts([(1, df.first().text)])
    assert {r[0] for r in got} == set(want) and {r[0]: r[4] for r in got}[run] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=9), min_size=1, max_size=12, unique=True))
def test_keys_and_gains(words):
    keys, places, of = spelling.deletion_keys(words)
    left = [words[i] if p < 0 else words[i][:p] + words[i][p + 1 :] for p, i in zip(places, of, strict=True)]
    by_text = {}
    for k, t in zip(keys.tolist(), left, strict=True):
        assert by_text.setdefault(t, k) == k  # equal texts have equal keys
    assert len(set(by_text.values())) == len(by_text)
    near = Counter()
    runs = {}
    for k, p, i in zip(keys.tolist(), places.tolist(), of.tolist(), strict=True):
        runs.setdefault(k % 3, []).append((p, i + 1, words[i]))  # runs of different texts, as if keys clashed
    for run in runs.values():
        for w, n, _ in spelling.near_in_run(run):
            near[w] += n
    assert near == +Counter({a: sum(plain_near(a, b) for b in words) for a in words})
    for a in words:
        for b in words:
            assert spelling.one_apart(a, b) == plain_near(a, b)


def test_keys_do_not_depend_on_the_batch():
    words = ["abcdefgh", "b" * 300, "éàüö"]
    alone = [sorted(spelling.deletion_keys([w])[0].tolist()) for w in words]
    keys, _, of = spelling.deletion_keys(words)
    assert alone == [sorted(keys[of == i].tolist()) for i in range(3)] and keys.dtype == np.uint64
