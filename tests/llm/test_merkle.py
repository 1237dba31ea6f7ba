"""The manifest against a plain version."""

import hashlib
import zlib
from collections import Counter, defaultdict

from scholium.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lower=False):
    text = row[4]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_tree(digests, fanout=16):
    """Top and, for each node, its siblings level by level with its own place."""
    paths, level, homes = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, home in enumerate(homes):
            first = home // fanout * fanout
            paths[i].append((level[first:home], level[home + 1 : first + fanout]))
            homes[i] = home // fanout
        level = [h(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], paths


def plain_trial(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for s in names}
    made = {s: plain_tree([plain_leaf(r) for r in order[s]]) for s in names}
    if not names:
        return Counter()
    root, over = plain_tree([made[s][0] for s in names])
    out = Counter()
    for s, above in zip(names, over, strict=True):
        for r, path in zip(order[s], made[s][1], strict=True):
            path = path + above
            fold = plain_leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in path:
                fold = h(*left, fold, *right)
            out[r[0], plain_leaf(r), made[s][0], root, h(*(x for left, right in path for x in (*left, *right))), fold, fold == root] += 1
    return out


def check(df):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert Counter(map(tuple, merkle.tamper_trial(df).collect())) == plain_trial(rows)


def test_trial(docs, odd, none):
    for df in (docs, odd, none):
        check(df)


def test_trees_of_several_levels(spark):
    n = 16 * 16 * 2 + 17  # the last runs have one node each
    rows = [(i, "hot" if i % 3 else f"s{i % 40:03}", "en", i, f"Text {i}") for i in range(n)] + [(5, "hot", None, None, None)] * 300
    check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7))
    check(spark.createDataFrame([(1, None, None, None, "Lone")], "doc_id long, source string, lang string, n_chars long, text string"))
    check(spark.createDataFrame([(i, str(i), None, 0, "") for i in range(35)], "doc_id long, source string, lang string, n_chars long, text string"))


def test_columns_that_are_absent_count_as_null(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B")], "doc_id long, text string")
    want = {(1, plain_leaf((1, None, None, None, "A"))), (2, plain_leaf((2, None, None, None, "B")))}
    assert {(r.doc_id, r.leaf) for r in merkle.manifest(df).collect()} == want
