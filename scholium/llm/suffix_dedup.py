"""Removal of repeated byte strings with suffix arrays.

Equal ``window``-byte strings have equal seeds (seeds.py). Around each repeated
seed the bytes of the windows that name it are cut out as a fragment; equal
fragments of a seed (by SHA-256, then by their bytes) are counted as one.
Fragments are dealt out by seed, so that all windows that may be equal meet in
one shard. A shard joins its fragments and builds their suffix array by induced
sorting: suffixes are classed as S or L, leftmost-smaller substrings are sorted
by inducing and named, the string of names is sorted, and the shard's array is
induced from it. Permuted common prefixes are then found where they cannot be
derived from the place before, and tell which windows have an equal neighbour.

The string of names is sorted by doubling names. Sorting it by the same
induction again gives the same array, but takes a step of the interpreter for
each of its tens of thousands of symbols (35 times the time of a shard).

A seed whose distinct fragments outgrow a shard is split by the bytes around it:
the windows that name it are told apart by where in them it stands, in ranges of
offsets, and all windows of a range share the bytes that make the range's own,
longer seed. Ranges get finer until each seed's fragments fit into a shard; the
finest hold one window each. So no common passage is gathered in one task, and
every result comes from a suffix array.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scholium.llm import seeds
from scholium.llm.common import written

WINDOW, GRAM = 400, 40
#: Bytes from which a shard is full, and beyond which a seed is split.
SHARD_BYTES, SEED_BYTES = 1 << 20, 2 << 20
#: Ranges of offsets of a seed in its windows, by level of splitting; a last level has as many as there are offsets.
RANGES = (1, 8, 64)
#: Fragments cut at a time, and bytes of unlike fragments that are held before they are sent.
LOT, HELD_BYTES = 1 << 16, 8 << 20


# ---- suffix array of bytes ---------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S)."""
    n = len(s)
    out = np.zeros(n, bool)
    differ = np.flatnonzero(s[:-1] != s[1:])
    if len(differ):  # a run of one symbol is of the kind of its end
        out[: differ[-1] + 1] = np.repeat(s[differ] < s[differ + 1], np.diff(differ, prepend=-1))
    return out


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones in order ``lms``.

    Buckets are filled from left to right with L suffixes, then from right to
    left with S suffixes; a bucket's entries are handled as one array.
    """
    n = len(s)
    heads = np.split(lms[np.argsort(s[lms], kind="stable")], np.searchsorted(np.sort(s[lms]), np.arange(1, alphabet)))
    larger: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    larger[int(s[n - 1])].append(np.array([n - 1]))  # the last suffix precedes all of its bucket

    def deal(entries: np.ndarray, to: list[list[np.ndarray]], kind: bool, own: int) -> np.ndarray:
        before = entries[entries > 0] - 1
        before = before[small[before] == kind]
        first = s[before]
        stay = before[first == own]
        others = before[first != own]
        if len(others):
            first = s[others]
            order = np.argsort(first, kind="stable")
            others, first = others[order], first[order]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for part in np.split(others, cuts):
                to[int(s[part[0]])].append(part)
        return stay

    def fill(c: int, to: list[list[np.ndarray]], kind: bool) -> None:
        """Bucket c as one array; entries that it gives itself are dealt in turn."""
        got = [np.concatenate(to[c])] if to[c] else []
        to[c] = got
        while got and len(stay := deal(got[-1], to, kind, c)):
            got.append(stay)
        to[c] = [np.concatenate(got)] if got else []

    for c in range(alphabet):
        fill(c, larger, False)
        if len(heads[c]):
            deal(heads[c], larger, False, -1)
    smaller: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    for c in range(alphabet - 1, -1, -1):
        fill(c, smaller, True)
        for part in larger[c]:
            deal(part[::-1], smaller, True, -1)
    out = []
    for c in range(alphabet):
        out += [*larger[c], *(x[::-1] for x in smaller[c])]
    return np.concatenate(out)


def _sorted_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a string of names in order of their first ``depth`` names at least, by doubling."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + behind
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= min(n, depth):
            return order


def suffix_array(s: np.ndarray, alphabet: int, depth: int | None = None) -> np.ndarray:
    """The suffix array of a string of small integers, none of which is special.

    With ``depth``, suffixes that agree in so many symbols may stand in any order.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induce(s, small, lms, alphabet)
    order = _induce(s, small, lms, alphabet)  # sorts the leftmost-smaller substrings
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    ends = np.append(lms[1:], n - 1)
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    size = ends[index[ranked]] - ranked + 1
    size[index[ranked] == len(lms) - 1] = n  # runs into the end: like no other
    new = np.ones(len(ranked), bool)
    same = np.flatnonzero(size[1:] == size[:-1]) + 1
    for k in range(int(size[same].max(initial=0)) if len(same) else 0):
        same = same[(k < size[same])]
        equal = s[ranked[same] + k] == s[ranked[same - 1] + k] if k < n else np.zeros(len(same), bool)
        done = same[equal & (size[same] == k + 1)]
        new[done] = False
        same = same[equal]
        if not len(same):
            break
    names = np.empty(len(lms), np.int64)
    names[index[ranked]] = np.cumsum(new) - 1
    inner = lms[np.argsort(names)] if new.all() else lms[_sorted_names(names, depth or n)]
    return _induce(s, small, inner, alphabet)


def permuted_lcp(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix with the one before in order.

    Where the symbols ahead of both suffixes agree the value is one less than at
    the place before; only at the other places symbols are compared.
    """
    n = len(s)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    derived = (at > 0) & (before > 0)
    derived[derived] = s[at[derived] - 1] == s[before[derived] - 1]
    fresh = np.flatnonzero(~derived & (before >= 0))
    left, other, length = fresh, before[fresh], np.zeros(len(fresh), np.int64)
    padded = np.concatenate([s.astype(np.int16), np.full(64, -1, np.int16)])
    live = np.arange(len(fresh))
    wide = np.arange(32)
    while len(live):
        a, b = left[live] + length[live], other[live] + length[live]
        differ = padded[np.minimum(a, n)[:, None] + wide] != padded[np.minimum(b, n)[:, None] + wide]
        differ |= (a[:, None] + wide >= n) | (b[:, None] + wide >= n)
        stop = differ.any(axis=1)
        length[live] += np.where(stop, differ.argmax(axis=1), 32)
        live = live[~stop]
    base = np.zeros(n, np.int64)
    base[fresh] = length + fresh
    starts = np.maximum.accumulate(np.where(~derived, at, 0))
    return np.where(before >= 0, np.maximum(base[starts] - at, 0), 0)


# ---- shards ------------------------------------------------------------------


def repeats(fragments: list[bytes], counts: list[int], window: int) -> list[list[int]]:
    """For each fragment the places where a window starts that occurs twice or more."""
    raw = b"".join(fragments)
    sizes = np.array([len(x) for x in fragments])
    ends = np.cumsum(sizes + 1)
    s = np.zeros(int(ends[-1]), np.int16)  # 0 between fragments
    inside = np.ones(len(s), bool)
    inside[ends - 1] = False
    s[inside] = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
    order = suffix_array(s, 257, window)
    common = permuted_lcp(s, order)
    again = common >= window
    twice = again.copy()
    twice[order[:-1]] |= again[order[1:]]
    many = np.repeat(np.array(counts) > 1, sizes + 1)
    left = np.repeat(ends - 1, sizes + 1) - np.arange(len(s))
    hit = (twice | many) & (left >= window)
    starts = ends - sizes - 1
    places = np.flatnonzero(hit)
    cut = np.searchsorted(places, np.append(starts, len(s)))
    return [(places[i:j] - at).tolist() for i, j, at in zip(cut[:-1], cut[1:], starts, strict=True)]


def runs(places) -> list[tuple[int, int]]:
    """(first, last) of each run of consecutive places."""
    p = np.asarray(places, np.int64)
    if not len(p):
        return []
    cut = np.flatnonzero(np.diff(p) > 1)
    return list(zip(p[np.concatenate([[0], cut + 1])].tolist(), p[np.append(cut, len(p) - 1)].tolist(), strict=True))


# ---- the job -----------------------------------------------------------------


def _pieces(raw: bytes, places: np.ndarray, window: int, gram: int, ranges: int):
    """Arrays (key, place of the seed, start, end) of the fragments of a text, in lots: the windows that name a seed, by ranges of its offset in them.

    The key is a hash of bytes that all windows of a range of that seed have.
    """
    symbols = seeds.symbols_of([raw], False)[0][:-1]
    grams = seeds.rolling(symbols, gram)
    del symbols
    named = np.concatenate([x for _, x in seeds.named_grams(grams, window - gram + 1)])
    edges = np.linspace(0, window - gram + 1, ranges + 1).astype(int).tolist()
    for lot in np.array_split(places, max(1, len(places) * ranges // LOT)):
        first, last = np.searchsorted(named, lot), np.searchsorted(named, lot, side="right") - 1
        if ranges == 1:
            yield grams[lot].view(np.int64), lot, first, last + window
            continue
        out = []
        for at, i, j in zip(lot.tolist(), first.tolist(), last.tolist(), strict=True):
            for low, high in zip(edges[:-1], edges[1:], strict=True):  # offsets [low, high): windows from at - high + 1 to at - low
                start, end = max(i, at - high + 1), min(j, at - low) + window
                if start + window <= end:
                    core = raw[at - low : at - high + 1 + window]
                    out.append((int.from_bytes(hashlib.sha256(b"%d " % low + core).digest()[:8], "little", signed=True), at, start, end))
        yield tuple(np.array(out, np.int64).reshape(-1, 4).T)


def _fragments(window: int, gram: int, ranges: int, with_bytes: bool):
    """The fragments of repeated seeds: key, first 128 bits of the SHA-256, and where they are or the bytes.

    Fragments are cut and hashed one at a time. What a lot has more than once is
    held and sent once, so a long run of few bytes, where every place is a seed, takes
    no more memory than other text.
    """

    def rows(batches):
        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def flush():
            sha = np.frombuffer(b"".join(k for _, k in held), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in held], pa.int64()), pa.array(sha[:, 0].copy()), pa.array(sha[:, 1].copy()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.binary())],
                ["gram", "f1", "f2", "weight", "fragment"])

        for batch in batches:
            copies = batch.column("copies").to_pylist() if with_bytes else None
            for k in range(batch.num_rows):
                raw = batch.column("text")[k].as_py().encode()
                places = np.sort(np.asarray(batch.column("places")[k].values, np.int64))
                for seed, at, first, end in _pieces(raw, places, window, gram, ranges):
                    digests = (hashlib.sha256(raw[i:j]).digest()[:16] for i, j in zip(first.tolist(), end.tolist(), strict=True))
                    if not with_bytes:
                        sha = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                        here = pa.array(np.full(len(at), k))
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (seed, sha[:, 0], sha[:, 1])] + [batch.column(c).take(here) for c in ("did", "th")] + [pa.array(np.ascontiguousarray(x)) for x in (at, first, end - first)],
                                                         ["gram", "f1", "f2", "did", "th", "at", "first", "size"])
                        continue
                    for g, digest, i, j in zip(seed.tolist(), digests, first.tolist(), end.tolist(), strict=True):
                        if (g, digest) in held:
                            held[g, digest][0] += copies[k]
                        else:
                            held[g, digest] = [copies[k], raw[i:j]]
                            size += j - i
                    if size > HELD_BYTES:
                        yield flush()
                        held, size = {}, 0
        if held:
            yield flush()

    return rows


def _sorted_shards(window: int, shard_bytes: int):
    """Runs of repeated windows of each fragment; rows come ordered by gram, f1, f2."""

    def rows(batches):
        keys, fragments, counts, size = [], [], [], 0

        def flush():
            alone = {}
            for g, _, _ in keys:
                alone[g] = alone.get(g, 0) + 1
            many = [i for i, k in enumerate(keys) if alone[k[0]] > 1]
            found = dict(zip(many, repeats([fragments[i] for i in many], [counts[i] for i in many], window), strict=True)) if many else {}
            out = []
            for i, k in enumerate(keys):
                if i in found:
                    out += [(*k, a, b) for a, b in runs(found[i])]
                elif counts[i] > 1:  # the seed's only fragment, more than once: nothing to sort
                    out.append((*k, 0, len(fragments[i]) - window))
            columns = list(zip(*out, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "f1", "f2", "a", "b"])

        for batch in batches:
            for g, f1, f2, weight, fragment in zip(*(batch.column(c).to_pylist() for c in ("gram", "f1", "f2", "weight", "fragment")), strict=True):
                if keys and keys[-1] == (g, f1, f2):
                    if fragments[-1] != fragment:
                        raise ValueError("unlike fragments have the same SHA-256")
                    counts[-1] += weight
                    continue
                if size >= shard_bytes and keys[-1][0] != g:
                    yield flush()
                    keys, fragments, counts, size = [], [], [], 0
                keys.append((g, f1, f2))
                fragments.append(fragment)
                counts.append(weight)
                size += len(fragment) + 1
        if keys:
            yield flush()

    return rows


def _cut(window: int):
    """What is left of a text without the bytes of its repeated windows."""

    def rows(batches):
        for batch in batches:
            out = []
            for raw, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                edges = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edges, [x["a"] for x in gone], 1)
                np.add.at(edges, [x["b"] + window for x in gone], -1)
                away = np.cumsum(edges[:-1]) > 0
                spans = int(away[0]) + int((away[1:] & ~away[:-1]).sum())
                out.append((int(away.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~away].tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["did", "th", "removed", "spans", "left"])

    return rows


def _islands(spans: DataFrame, window: int) -> DataFrame:
    """did, th, a, b: spans whose windows touch or overlap, as one; so a text has fewer than one for each ``window`` bytes."""
    order = Window.partitionBy("did", "th").orderBy("a")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.coalesce((F.col("a") > before + window).cast("int"), F.lit(1)))
    return rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("did", "th", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs``.

    A null text is empty. Every row is a document of its own, also with a null
    or repeated doc_id or as a repeated row: of equal texts of ``window`` bytes
    or more nothing is left. Shorter texts keep all. Other columns are not
    looked at. An empty table gives no rows.
    """
    rows = seeds.scan(docs, lambda raw: (len(raw), ""), False, window, gram)
    reps = seeds.representatives(rows)
    texts = seeds.repeated(docs, rows, reps, other_text=False)
    source, marks, bodies = texts, None, None
    for ranges in (*(x for x in RANGES if x < window - gram + 1), window - gram + 1):
        here = written(source.select("did", "th", "text", "places").mapInArrow(_fragments(window, gram, ranges, False), "gram long, f1 long, f2 long, did long, th long, at long, first long, size long"), "fragments")
        wide = here.select("gram", "f1", "f2", "size").distinct().groupBy("gram").agg(F.sum("size").alias("bytes")).where((F.col("bytes") > seed_bytes) & F.lit(ranges <= window - gram)).select("gram")
        wide = written(wide, "wide-seeds")
        done = wide.isEmpty()
        cut = source.select("did", "th", "text", "places", "copies").mapInArrow(_fragments(window, gram, ranges, True), "gram long, f1 long, f2 long, weight long, fragment binary")
        if not done:
            again = here.join(wide, "gram", "left_semi").groupBy("did", "th").agg(F.collect_set(F.col("at").cast("int")).alias("places"))
            here, cut = here.join(wide, "gram", "left_anti"), cut.join(wide, "gram", "left_anti")
        marks, bodies = (here, cut) if marks is None else (marks.unionByName(here), bodies.unionByName(cut))
        if done:
            break
        source = written(texts.drop("places").join(again, ["did", "th"]), "split-texts")
    shards = bodies.repartition("gram").sortWithinPartitions("gram", "f1", "f2")
    found = written(shards.mapInArrow(_sorted_shards(window, shard_bytes), "gram long, f1 long, f2 long, a long, b long"), "repeated-runs")
    gone = marks.join(found, ["gram", "f1", "f2"]).select("did", "th", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    gone = _islands(gone, window).groupBy("did", "th").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    cut = texts.where("copies = 1").select("did", "th", "text").join(gone, ["did", "th"]).mapInArrow(_cut(window), "did long, th long, removed long, spans long, left string")
    cut = written(cut, "cut-texts")
    every = rows.select("did", "th", "sha", "n").join(reps.select("sha", "copies"), "sha").join(cut, ["did", "th"], "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= window)
    return every.select(
        F.when(F.col("did") != seeds.NO_ID, F.col("did")).alias("doc_id"), F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"))
