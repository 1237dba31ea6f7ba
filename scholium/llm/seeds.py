"""Seeds: where two texts may share a long passage.

Any window of ``window`` symbols (words or bytes) names one of its ``gram``-symbol
grams, the one of the least hash, leftmost if tied. Equal windows name equal
grams, so a window can occur twice only if its gram, the seed, does. That holds for
any hash; where a hash is the same for unlike grams, more is looked at than needed. Seeds are
found in one pass, about two for every ``window - gram`` symbols; what follows
works on the texts around repeated seeds alone, and no repeat is lost.

Equal texts are set aside first: of each group of copies one stands for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scholium.llm.common import text_of, written

#: Bytes of text that are hashed at a time; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Windows whose least gram is sought at a time; their places take the low bits of a key.
PLACES = 24
NO_ID = (1 << 63) - 1
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers over all bits (one-to-one)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _power(which: int, inverse: bool, n: int) -> np.ndarray:
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = int(_BASES[which])
        step = _U(pow(base, -1, 1 << 64) if inverse else base)
        size = max(n, 2 * CHUNK_BYTES)
        have = np.ones(size, np.uint64)
        have[1:] = step
        have = _powers[which, inverse] = np.cumprod(have)
    return have[:n]


def prefix_sums(symbols: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _power(which, False, len(symbols)), out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of symbols [start, end): equal if the symbols are. Unlike symbols may agree too; no result rests on their not doing so."""
    return (sums[end] - sums[start]) * _power(which, True, len(sums))[start]


def rolling(symbols: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` symbols."""
    if len(symbols) < size:
        return np.zeros(0, np.uint64)
    at = np.arange(len(symbols) - size + 1)
    return mixed(between(prefix_sums(symbols, which), at, at + size, which))


def word_symbols(raw: bytes) -> np.ndarray:
    """A hash of each word's bytes. Words are told apart by a hash that is no polynomial in their letters."""
    words = raw.split()  # bytes: only ASCII white space splits
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def named_grams(grams: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, place of the gram named by each window of ``width`` grams from start on), in slices."""
    step, low = (1 << PLACES) - width, _U((1 << PLACES) - 1)
    for a in range(0, max(len(grams) - width + 1, 0), step):
        part = grams[a : a + step + width - 1]
        least, size = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * size <= width:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        yield a, (least & low).astype(np.int64) + a


def least_grams(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Places of the grams that the ``valid`` windows name, ascending."""
    out = []
    for a, named in named_grams(grams, width):
        named = named[valid[a : a + len(named)]]  # never descends
        out.append(named[np.diff(named, prepend=-1) > 0])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def chunks(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_BYTES`` together."""
    start, size = 0, 0
    for i, raw in enumerate(raws):
        if size and size + len(raw) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(raw) + 1
    if raws:
        yield start, len(raws)


def joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, a line end after each, and where each starts."""
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raws])])
    return np.frombuffer(b"\n".join(raws) + b"\n", np.uint8), starts


def symbols_of(raws: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Symbol hashes of texts one after the other, and where each text starts in them."""
    if not words:
        buffer, starts = joined(raws)
        return _BYTES[buffer], starts
    found = [word_symbols(raw) for raw in raws]
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])


def _whole(starts: np.ndarray, ends: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n places start a window inside one text."""
    edges = np.zeros(n + 1, np.int64)
    long = ends - starts >= window
    np.add.at(edges, starts[long], 1)
    np.add.at(edges, ends[long] - window + 1, -1)
    return np.cumsum(edges[:-1]) > 0


def seeds(raws: list[bytes], words: bool, window: int, gram: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(gram hashes, places in the text) of the seeds of each text."""
    out = []
    for a, b in chunks(raws):
        symbols, starts = symbols_of(raws[a:b], words)
        lo, hi = starts[:-1], starts[1:] if words else starts[1:] - 1
        grams = rolling(symbols, gram)
        at = least_grams(grams, _whole(lo, hi, len(symbols), window), window - gram + 1)
        cut = np.searchsorted(at, starts)
        out += [(grams[at[i:j]], at[i:j] - s) for i, j, s in zip(cut[:-1], cut[1:], starts, strict=False)]
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """did, th, text: a doc_id (null: beyond all others), a hash of the text, and the text."""
    text = text_of()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def scan(docs: DataFrame, facts: Callable[[bytes], tuple[int, str]], words: bool, window: int, gram: int) -> DataFrame:
    """Writes one row per text: did, th, sha, n and kept (what ``facts`` returns), grams, places."""

    def rows(batches):
        for batch in batches:
            raws = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            found, told = seeds(raws, words, window, gram), [facts(x) for x in raws]
            sizes = np.concatenate([[0], np.cumsum([len(g) for g, _ in found])]).astype(np.int32)
            grams = np.concatenate([g for g, _ in found]) if found else np.zeros(0, np.uint64)
            places = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("th"), batch.column("sha"), pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.string()),
                 pa.ListArray.from_arrays(pa.array(sizes), pa.array(grams.view(np.int64))), pa.ListArray.from_arrays(pa.array(sizes), pa.array(places.astype(np.int32)))],
                ["did", "th", "sha", "n", "kept", "grams", "places"])

    shas = keyed(docs).select("did", "th", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")
    return written(shas.mapInArrow(rows, "did long, th long, sha string, n long, kept string, grams array<long>, places array<int>"), "seeds")


def representatives(rows: DataFrame) -> DataFrame:
    """sha, did, th, copies: of equal texts the row with the smallest did."""
    best = rows.groupBy("sha").agg(F.min(F.struct("did", "th")).alias("best"), F.count(F.lit(1)).alias("copies"))
    return written(best.select("sha", "best.did", "best.th", "copies"), "representatives")


def repeated(docs: DataFrame, rows: DataFrame, reps: DataFrame, other_text: bool) -> DataFrame:
    """Writes did, th, text, copies, places of the representatives with a seed that another place has.

    ``other_text``: the other place must be in another text.
    """
    own = written(rows.join(reps.select("did", "th", "copies"), ["did", "th"]).select("did", "th", "copies", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("did", "th", "copies", "x.*"), "own-seeds")
    groups = own.groupBy("grams").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("low"), F.max("th").alias("high"))
    shared = written(groups.where("low < high" if other_text else "n > 1").select("grams"), "shared-seeds")  # so that Spark can split the join of a hot seed
    places = own.join(shared, "grams", "left_semi").groupBy("did", "th", "copies").agg(F.collect_set("places").alias("places"))
    return written(keyed(docs).join(places, ["did", "th"]), "seeded-texts")
