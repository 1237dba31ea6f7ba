"""Spelling variants: words one code point apart, and the more frequent form that each belongs to.

Two words are near just if one of them is the other without one code point, or both
are the same without the code point at one place. So every word gives a key for
itself and one for each deletion: a polynomial hash of what is left, put together
from a prefix's and a suffix's hash, in NumPy, for a whole batch of words at once.
Keys are dealt out by their leading bits and sorted; in a run of equal keys the
words themselves decide what is near. A run holds few words: those that agree
but for one letter at a place, at most the alphabet's size for each place.

No pair of words is written. Of each set of near words a word gets its number and
the most frequent one besides itself, so a letter's worth of variants costs as much
as there are words.

A key's row has its word beside it, so a word of L letters makes L + 1 rows of L
letters. Keys of more than ``LONG`` code points have a digest of the word instead;
the few words that meet are looked up and compared afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scholium.llm.common import text_of, written

RUN_PATTERN = r"[A-Za-zÀ-ÿ]{7,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least code points and occurrences of a word, how much more frequent a form is, and one run in so many that loses a letter.
LEAST_LENGTH, LEAST_COUNT, TIMES, SLIP_EVERY = 7, 2, 10, 31
#: Code points of a key up to which its rows have the word, and words or key rows made at a time.
LONG, STEP = 128, 200_000
RADIX_BITS = 16
#: An odd base has an inverse modulo 2**64, so a prefix's hash can be moved to the start of a word.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
OWN = -1

KEYS = "key long, pos int, n long, word string, long_id string"
GAINS = "word string, n_near long, best struct<order:long,form:string>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, base & ((1 << 64) - 1), np.uint64), dtype=np.uint64)))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, places (``OWN`` for the word itself) and the index of the word that each comes from."""
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    power, back = _powers(BASE, len(letters)), _powers(INVERSE, len(letters) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_mixed(letters + np.uint64(1)) * power[: len(letters)], dtype=np.uint64)))
    own = (sums[ends] - sums[starts]) * back[starts]
    of = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(letters))
    first = starts[of]
    prefix, suffix = sums[at] - sums[first], sums[ends[of]] - sums[at + 1]
    without = prefix * back[first] + suffix * back[first + 1]
    keys = np.concatenate((own, without))
    left = np.concatenate((lengths, lengths[of] - 1)).astype(np.uint64)
    keys = _mixed(keys + left * np.uint64(0xD6E8FEB86659FD93))
    places = np.concatenate((np.full(len(words), OWN, np.int64), at - first))
    return keys, places, np.concatenate((np.arange(len(words)), of))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the distinct words of all texts, with slips made as the contract says.

    A null text has no words; a null doc_id counts as empty.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(), F.lit(RUN_PATTERN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = (h % F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    words = runs.select(F.when(h % SLIP_EVERY == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _key_rows(batches):
    schema = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("n", pa.int64()), ("word", pa.string()), ("long_id", pa.string())])
    for batch in batches:
        words, ids, counts = batch.column("word").to_pylist(), batch.column("id").to_pylist(), batch.column("n").to_numpy()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // STEP, prepend=-1))  # lots of about STEP letters, or one long word
        for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True):
            keys, places, of = deletion_keys(words[a:b])
            size = lengths[a:b][of] - (places != OWN)
            for lo in range(0, len(keys), STEP):
                part = slice(lo, lo + STEP)
                mine = of[part] + a
                short = size[part] <= LONG
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[part].view(np.int64)), pa.array(places[part].astype(np.int32)), pa.array(counts[mine]),
                    pa.array([words[i] if s else None for i, s in zip(mine, short, strict=True)], pa.string()),
                    pa.array([None if s else ids[i] for i, s in zip(mine, short, strict=True)], pa.string())], schema=schema)


def _runs(batches):
    """Lists of the rows of two or more with the same key, from batches in the order of keys; a run may go on in the next batch."""
    carried = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if carried is None else [carried, batch]).combine_chunks()
        keys = table.column("key").to_numpy()
        if not len(keys):
            continue
        edges = np.flatnonzero(np.diff(keys)) + 1
        last = int(edges[-1]) if len(edges) else 0
        carried = table.slice(last).to_batches()[0] if table.num_rows > last else None
        starts, ends = np.concatenate(([0], edges))[: len(edges)], edges
        yield from _taken(table, starts, ends)
    if carried is not None:
        yield from _taken(pa.Table.from_batches([carried]), np.array([0]), np.array([carried.num_rows]))


def _taken(table, starts, ends):
    many = ends - starts > 1
    if not many.any():
        return
    starts, ends = starts[many], ends[many]
    marks = np.zeros(table.num_rows + 1, np.int64)
    marks[starts] += 1
    marks[ends] -= 1
    rows = table.filter(pa.array(np.cumsum(marks[:-1]) > 0))
    pos, n, word, long_id = (rows.column(c).to_pylist() for c in ("pos", "n", "word", "long_id"))
    at = 0
    for size in (ends - starts).tolist():
        yield list(zip(pos[at : at + size], n[at : at + size], word[at : at + size], long_id[at : at + size], strict=True))
        at += size


def near_in_run(run: list[tuple]) -> list[tuple]:
    """(word, n_near, (-n, form)) that words of a run gain from each other; ``run`` has (place, n, word)."""
    same: dict[str, list] = {}
    for pos, n, word in run:
        same.setdefault(word if pos == OWN else word[:pos] + word[pos + 1 :], []).append((pos, n, word))
    gained = []
    for rows in same.values():
        if len(rows) < 2:
            continue
        by_place: dict[int, list] = {}
        for pos, n, word in rows:
            by_place.setdefault(pos, []).append((-n, word))
        whole = by_place.pop(OWN, None)
        if whole:  # the first of equal letters stands for all of them: each longer word once
            longer = [x for pos, group in by_place.items() for x in group if pos == 0 or x[1][pos] != x[1][pos - 1]]
            if longer:
                gained += [(whole[0][1], len(longer), min(longer)), *((word, 1, whole[0]) for _, word in longer)]
        for group in by_place.values():
            if len(group) > 1:
                best, second = sorted(group)[:2]
                gained += [(x[1], len(group) - 1, second if x == best else best) for x in group]
    return gained


def _gains(batches):
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("order", pa.int64()), ("form", pa.string())]))])
    out = []

    def made():
        words, near, best = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.int64()), pa.array([{"order": o, "form": f} for o, f in best], schema.field("best").type)], schema=schema)

    for run in _runs(batches):
        out += near_in_run([(pos, n, word) for pos, n, word, _ in run if word is not None])
        if len(out) > 20_000:
            yield made()
            out = []
    if out:
        yield made()


def _long_pairs(batches):
    """(a, b): digests of long words that may be near, each pair of a run's set once."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])
    for run in _runs(batches):
        rows = sorted({(pos, x) for pos, _, _, x in run})
        own = [x for pos, x in rows if pos == OWN]
        pairs = {(a, x) for a in own for pos, x in rows if pos != OWN}
        for k, (pos, x) in enumerate(rows):  # words that differ at one place: no more than the alphabet has letters
            for other, y in rows[k + 1 :]:
                if pos == OWN or other != pos:
                    break
                pairs.add((x, y))
        if pairs:
            a, b = zip(*sorted(pairs), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], schema=schema)


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    x, y = (np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4") for w in (a, b))
    differ = np.flatnonzero(x != y[: len(x)])
    at = int(differ[0]) if len(differ) else len(x)
    return bool((x[at + 1 :] == y[at + 1 :]).all()) if len(x) == len(y) else bool((x[at:] == y[at + 1 :]).all())


def _verified(batches):
    for batch in batches:
        keep = [one_apart(a, b) for a, b in zip(batch.column("aw").to_pylist(), batch.column("bw").to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _near_long(keys: DataFrame, words: DataFrame) -> DataFrame:
    """What long words gain from each other: candidates by key, decided by the words."""
    pairs = written(_dealt(keys.where("long_id is not null")).mapInArrow(_long_pairs, "a string, b string").distinct(), "long-pairs")
    some = words.select("id", "word", "n")
    both = pairs.join(some.select(F.col("id").alias("a"), F.col("word").alias("aw"), F.col("n").alias("an")), "a").join(some.select(F.col("id").alias("b"), F.col("word").alias("bw"), F.col("n").alias("bn")), "b")
    both = both.select("aw", "an", "bw", "bn")
    both = both.mapInArrow(_verified, both.schema)
    each = F.explode(F.array(F.struct(F.col("aw").alias("word"), F.col("bw").alias("form"), F.col("bn").alias("n")), F.struct(F.col("bw").alias("word"), F.col("aw").alias("form"), F.col("an").alias("n"))))
    return both.select(each.alias("x")).select("x.word", F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("x.n")).alias("order"), F.col("x.form").alias("form")).alias("best"))


def _dealt(keys: DataFrame) -> DataFrame:
    """Key rows dealt out by the keys' leading bits, each part sorted."""
    return keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "pos")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (order: -n, form: the near word of largest n, the least of equals) of words that have near ones.

    ``words`` has distinct words and their n.
    """
    words = written(words.select("word", "n", F.when(F.char_length("word") > LONG, F.sha2(F.col("word").cast("binary"), 256)).alias("id")), "spelling-words")
    keys = words.where(F.char_length("word") <= LONG + 1).mapInArrow(_key_rows, KEYS)
    gains = _dealt(keys.where("word is not null")).mapInArrow(_gains, GAINS)
    long = words.where("id is not null")
    if not long.isEmpty():
        gains = gains.unionByName(_near_long(long.mapInArrow(_key_rows, KEYS), long))
    return gains.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: ``forms`` (word, form) followed to the last; each round doubles the way.

    A form is ``TIMES`` as frequent as its word, so the way is short and never a circle.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per row of ``words`` (word, n), which are distinct."""
    near = neighbours(words)
    n_form = -F.col("best.order")
    belongs = n_form >= F.col("n") * times
    rows = words.join(near, "word", "left").select("word", F.when(belongs, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(belongs, n_form).alias("form_n"))
    rows = written(rows, "forms")
    return rows.join(roots(rows.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of at least 7 code points that ``docs`` have twice.

    Every row's whole text counts, repeated rows each for themselves. A null or
    empty text has no words, a null doc_id counts as an empty one; words of any
    length are compared whole. Of near words that are equally frequent the least in
    code-point order is the form. Other columns are not looked at; an empty table,
    or one without such words, gives no rows.
    """
    return variants(written(word_counts(docs), "word-counts"))
