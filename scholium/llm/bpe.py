"""BPE encoding and decoding of whole texts with a public tokenizer file.

The file's pattern leaves no merge across white space, nor across the pieces that
it cuts words into: runs of letters, single digits, runs of other signs, endings
such as 's. Texts are cut into pieces a few million bytes at a time, by tables
over bytes; the pieces of such a chunk are put into a dictionary by Arrow, so
that each distinct one is encoded once and the ids of the rest are looked up.
Words with characters beyond printable ASCII and the letters of Western European
languages, or with ``<|``, take the file's own normaliser and splitter.

Every piece longer than ``LEAF`` symbols is encoded by tree concatenation: its
leaves are encoded by themselves, then two neighbours are joined by encoding a
window around the join again, which grows until it starts with the token that
the left side has there and ends with the token that the right side has there.
All pairs of neighbouring tokens are then pairs of a correct encoding, which
makes the whole one. Texts with an unsplit run of ``SPREAD`` bytes or more are
cut into branches that Spark deals out to tasks; each task encodes its branches
by their trees, and the branches of a text are joined in one more step.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from scholium.llm.common import text_of, written

#: Symbols of a leaf of the tree, and tokens on each side of a join at first.
LEAF, JOIN = 16, 4
#: Bytes without white space from which a text's pieces are dealt out in branches, and symbols of a branch.
SPREAD, BRANCH = 1 << 16, 1 << 13
#: Bytes of text that are cut into pieces at a time; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Leaves that go to the library at a time.
LEAVES = 2048
#: Pieces that a worker remembers before it starts anew: by itself, and where a worker
#: goes on with other stages, which its memory must leave room for.
REMEMBERED, REMEMBERED_BESIDE = 700_000, 100_000
#: Pieces that need no normalising but lower case.
_USUAL = re.compile("[!-~À-ÖØ-öø-ÿŒœ]+")
# The pattern that a file must cut words by, and its endings of words.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
for _from, _to, _kind in (("a", "z", _LETTER), ("A", "Z", _LETTER), ("0", "9", _DIGIT)):
    _KIND[ord(_from) : ord(_to) + 1] = _kind
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Second bytes of the two-byte letters taken as usual, by first byte; capitals lie 32 (C3) or 1 (C5) below.
_SECOND = {0xC3: [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)], 0xC5: [0x92, 0x93]}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def join_encodings(left: list[int], right: list[int], text: Callable[[list[int]], str], encode: Callable[[str, bool], list[int]], ends: bool) -> list[int]:
    """The encoding of the concatenation. ``ends``: the right side ends its piece."""
    w = JOIN
    while True:
        a, b = left[-w:], right[:w]
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        window = encode(text(a) + text(b), ends and whole_right)
        if (whole_left or window[:1] == a[:1]) and (whole_right or window[-1:] == b[-1:]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        w *= 2


def join_all(level: list[list[int]], text: Callable, encode: Callable[[str, bool], list[int]], ends: bool = True) -> list[int]:
    """Joins neighbours, level by level, until one encoding is left. ``ends``: the last one ends its piece."""
    while len(level) > 1:
        pairs = range(0, len(level) - 1, 2)
        level = [join_encodings(level[i], level[i + 1], text, encode, ends and i + 2 == len(level)) for i in pairs] + level[len(level) - len(level) % 2 :]
    return level[0] if level else []


def tree_encode(symbols: str, text: Callable, encode: Callable[[str, bool], list[int]], leaf: int = LEAF, ends: bool = True) -> list[int]:
    """Encodes a piece, given as symbols, from leaves of ``leaf`` symbols up."""
    return join_all([encode(symbols[i : i + leaf], ends and i + leaf >= len(symbols)) for i in range(0, len(symbols), leaf)], text, encode, ends)


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _members(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of the ranges [start, end)."""
    sizes = end - start
    return np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def cut_pieces(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, starts): the pieces of texts, each of which ends with a line end, end to end in
    lower case, where each starts and the last ends in these bytes, and where it starts in ``buffer``.

    A word with odd characters is one piece, as it stands.
    """
    lower, kind = _LOWER[buffer], _KIND[buffer]
    high = np.flatnonzero(buffer >= 128)
    for first, seconds in _SECOND.items():
        lead = high[buffer[high] == first]
        lead = lead[np.isin(buffer[lead + 1], seconds)]
        kind[lead] = kind[lead + 1] = _LETTER
        capital = lead[buffer[lead + 1] < (0x9F if first == 0xC3 else 0x93)]
        lower[capital + 1] += 32 if first == 0xC3 else 1
    inside = kind != _SPACE
    odd = np.concatenate([np.flatnonzero(kind == _ODD), np.flatnonzero((buffer[:-1] == ord("<")) & (buffer[1:] == ord("|")))])
    if len(odd):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        words = np.unique(np.searchsorted(edges[::2], odd, side="right") - 1)
        whole = _members(edges[::2][words], edges[1::2][words])
        kind[whole], lower[whole] = _ODD, buffer[whole]
    start = inside & (kind == _DIGIT)
    start |= np.concatenate([[True], kind[1:] != kind[:-1]]) & inside
    mark = np.flatnonzero(start & (buffer == ord("'")) & (kind == _OTHER))
    mark = mark[kind[mark + 1] == _LETTER]
    if len(mark):
        padded = np.concatenate([lower, np.zeros(3, np.uint8)])
        for ending in _ENDINGS:
            size, found = len(ending), mark
            for i, byte in enumerate(ending, 1):
                found = found[padded[found + i] == byte]
            start[found + 1] = False
            after = found + size + 1
            start[after[kind[after] == _LETTER]] = True
    starts = np.flatnonzero(start)
    upto = np.cumsum(inside, dtype=np.int64)
    return lower[inside], np.append(upto[starts] - 1, upto[-1] if len(upto) else 0), starts


class Encoder:
    """Texts to ids."""

    def __init__(self, path: str, leaf: int = LEAF, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if _PATTERN not in json.dumps(spec["pre_tokenizer"]).encode().decode("unicode_escape"):
            raise ValueError(f"{path} does not cut words by the pattern {_PATTERN}")
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.inner = BPE(model["vocab"], merges)
        self.final = BPE(model["vocab"], merges, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        self.alone = Tokenizer(self.final)  # without normaliser and splitter: a text is one piece
        self.tokens = [""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.tokens[i] = token
        self.shown = pa.array([f"{x} ".encode() for x in self.tokens], pa.large_binary())
        self.bare = [x.removesuffix(self.suffix) if self.suffix else x for x in self.tokens]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else re.compile("(?!)")
        self.leaf, self.remembered = leaf, remembered
        self.symbols = byte_symbols()
        self.forget()

    def forget(self) -> None:
        """known: each piece's number; flat[first[k] : first[k + 1]]: ids of piece k."""
        self.known: dict[bytes, int] = {}
        self.flat, self.first = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def encode(self, symbols: str, ends: bool) -> list[int]:
        return [t.id for t in (self.final if ends else self.inner).tokenize(symbols)]

    def text(self, ids: list[int]) -> str:
        return "".join(map(self.bare.__getitem__, ids))

    def pieces(self, raw: bytes) -> Iterator[str | int]:
        """The pieces of a usual piece or of a whole word as symbols, and the ids of special tokens."""
        word = raw.decode()
        if _USUAL.fullmatch(word) and "<|" not in word:
            yield word if word.isascii() else raw.decode("latin-1").translate(self.symbols)
            return
        for part in self.split_special.split(word):
            if part in self.special:
                yield self.special[part]
            elif part:
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    yield piece

    def _learn(self, raws: list[bytes]) -> None:
        """Encodes pieces that are not known; those of one leaf go to the library's model together."""
        found: list[list[int]] = []
        leaves, at = [], []
        for k, raw in enumerate(raws):
            parts = list(self.pieces(raw))
            if len(parts) == 1 and isinstance(parts[0], str) and len(parts[0]) <= self.leaf:
                leaves.append(parts[0])
                at.append(k)
                found.append([])
            else:
                found.append([x for p in parts for x in ([p] if isinstance(p, int) else tree_encode(p, self.text, self.encode, self.leaf))])
        for i in range(0, len(leaves), LEAVES):  # the library's records of a piece take far more room than its ids
            for k, x in zip(at[i : i + LEAVES], self.alone.encode_batch_fast(leaves[i : i + LEAVES], add_special_tokens=False), strict=True):
                found[k] = x.ids
        sizes = np.array(list(map(len, found)), np.int64)
        n, ids = len(self.known), np.array([x for y in found for x in y], np.uint32)
        start = int(self.first[n])
        while len(self.first) < n + len(raws) + 1:
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while len(self.flat) < start + len(ids):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.first[n + 1 : n + len(raws) + 1] = start + np.cumsum(sizes)
        self.flat[start : start + len(ids)] = ids
        self.known.update(zip(raws, range(n, n + len(raws)), strict=True))

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, pieces))
        missing = [p for p, k in zip(pieces, found, strict=True) if k is None]
        if missing:
            if len(self.known) + len(missing) > self.remembered:
                self.forget()
                missing = pieces
            self._learn(missing)
            found = list(map(self.known.__getitem__, pieces))
        return np.array(found, np.int64)

    def chunk(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts end to end, and how many each text has."""
        text_starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raws])])
        data, offsets, starts = cut_pieces(np.frombuffer(b"\n".join(raws) + b"\n", np.uint8))
        kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
        pieces = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(data)]).dictionary_encode()
        number = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
        first = self.first[number]
        sizes = self.first[number + 1] - first
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(first - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, text_starts)])

    def texts(self, raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``chunk`` of all texts, about ``CHUNK_BYTES`` at a time."""
        start, size = 0, 0
        for i, raw in enumerate(raws):
            if size and size + len(raw) > CHUNK_BYTES:
                yield self.chunk(raws[start:i])
                start, size = i, 0
            size += len(raw) + 1
        if raws:
            yield self.chunk(raws[start:])

    def decoded(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """As the library: without a decoder in the file, tokens joined by spaces. Bytes of the tokens, each
        with a space behind it, and where each starts."""
        taken = pc.take(self.shown, pa.array(ids))
        if not len(taken):
            return memoryview(b""), np.zeros(1, np.int64)
        _, offsets, data = taken.buffers()
        return memoryview(data), np.frombuffer(offsets, np.int64)[: len(ids) + 1]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """This worker's encoder; it outlives a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already; the library's threads would only wait on each other
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = Encoder(path, remembered=remembered)
    return _encoders[path, remembered]


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()]


def digests(own: Encoder, ids: np.ndarray, counts: np.ndarray) -> tuple[list[str], list[str]]:
    """SHA-256 of each text's ids and of its decoded text."""
    ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
    packed, (shown, at) = memoryview(ids.astype("<u4")).cast("B"), own.decoded(ids)
    spans = list(zip(ends[:-1], ends[1:], strict=True))
    return [hashlib.sha256(packed[4 * i : 4 * j]).hexdigest() for i, j in spans], [hashlib.sha256(shown[at[i] : at[j] - (i < j)]).hexdigest() for i, j in spans]


def _record(own: Encoder, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, with_ids: bool) -> pa.RecordBatch:
    columns = [doc_ids, pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in digests(own, ids, counts))]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])


def give_back() -> None:
    """Returns freed memory to the system, where the C library can, for the stages that the worker goes on with."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _usual(path: str, with_ids: bool, remembered: int):
    def rows(batches):
        own = encoder(path, remembered)
        for batch in batches:
            at = 0
            for ids, counts in own.texts(raw_texts(batch)):
                yield _record(own, batch.column("doc_id").slice(at, len(counts)), ids, counts, with_ids)
                at += len(counts)
        if remembered <= REMEMBERED_BESIDE:
            own.forget()
            give_back()

    return rows


def _branches(path: str, branch: int):
    """Each text as a row of its pieces: place, the symbols of a branch (or the id of a special token), and whether it starts and ends its piece."""

    def rows(batches):
        own = encoder(path)
        for batch in batches:
            for k, raw in enumerate(raw_texts(batch)):
                data, offsets, _ = cut_pieces(np.frombuffer(raw + b"\n", np.uint8))
                whole, out = data.tobytes(), []
                for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    for piece in own.pieces(whole[i:j]):
                        if isinstance(piece, int):
                            out.append((None, piece, True, True))
                            continue
                        out += [(piece[a : a + branch], None, a == 0, a + branch >= len(piece)) for a in range(0, len(piece), branch)]
                symbols, special, begins, ends = zip(*out, strict=True) if out else ([],) * 4
                uid, doc_id = (pa.array([batch.column(c)[k].as_py()] * len(out), batch.column(c).type) for c in ("uid", "doc_id"))
                yield pa.RecordBatch.from_arrays([uid, doc_id, pa.array(range(len(out)), pa.int64()), pa.array(symbols, pa.string()), pa.array(special, pa.int32()), pa.array(begins, pa.bool_()), pa.array(ends, pa.bool_())],
                                                 ["uid", "doc_id", "place", "symbols", "special", "begins", "ends"])

    return rows


def _encoded(path: str):
    def rows(batches):
        own = encoder(path)
        for batch in batches:
            ids = [[x] if s is None else tree_encode(s, own.text, own.encode, own.leaf, e) for s, x, e in zip(*(batch.column(c).to_pylist() for c in ("symbols", "special", "ends")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "doc_id", "place", "begins", "ends")), pa.array(ids, pa.list_(pa.int32()))], ["uid", "doc_id", "place", "begins", "ends", "ids"])

    return rows


def _joined(path: str, with_ids: bool):
    def rows(batches):
        own = encoder(path)
        for batch in batches:
            for k, branches in enumerate(batch.column("branches").to_pylist()):
                ids: list[int] = []
                piece: list[list[int]] = []
                for x in branches:
                    piece.append(x["ids"])
                    if x["ends"]:
                        ids += join_all(piece, own.text, own.encode)
                        piece = []
                yield _record(own, batch.column("doc_id").slice(k, 1), np.array(ids, "<u4"), np.array([len(ids)]), with_ids)

    return rows


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False, spread: int = SPREAD, branch: int = BRANCH, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    One row per row of ``docs``. A null text is empty and has no ids; null or
    repeated doc_ids and repeated rows are encoded one by one; other columns are
    not looked at. An empty table gives no rows.
    """
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    plain = docs.select("doc_id", text_of().alias("text"))
    # whether white space is missing for so long is only asked of texts that are as long
    unsplit = F.when(F.octet_length("text") >= spread, F.col("text").rlike(r"[^\x20\x09-\x0D]{%d}" % max(spread // 4, 1))).otherwise(False)
    long = plain.where(unsplit).withColumn("uid", F.monotonically_increasing_id())
    pieces = written(long.mapInArrow(_branches(path, branch), f"uid long, doc_id {kind}, place long, symbols string, special int, begins boolean, ends boolean"), "bpe-branches")
    usual = plain.where(~unsplit).mapInArrow(_usual(path, with_ids, remembered), schema)
    if pieces.isEmpty():
        return usual
    ids = pieces.repartition("uid", "place").mapInArrow(_encoded(path), f"uid long, doc_id {kind}, place long, begins boolean, ends boolean, ids array<int>")
    texts = ids.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("place", "begins", "ends", "ids"))).alias("branches"))
    return usual.unionByName(texts.mapInArrow(_joined(path, with_ids), schema))
