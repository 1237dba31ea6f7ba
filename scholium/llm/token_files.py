"""Token ids in a grammar-compressed binary format (Re-Pair).

Documents are put in ascending order of doc_id by a range partitioning. Each
partition encodes its texts, ends each document with id ``END`` and cuts the ids
into blocks of about ``BLOCK_TOKENS``. A block is compressed by itself: its most
frequent pairs of neighbouring symbols are replaced by new symbols, again and
again, until no pair is seen ``MIN_COUNT`` times. There may be any number of new
symbols; all symbols of a block take as many bits as its largest one needs.
Blocks are rows of a Parquet table
(part, block, n_docs, n_tokens, data); ``data`` holds, little-endian:

    4 bytes  magic "RPR2"
    5 x u32  documents, terminals (the first rule's symbol), rules, symbols of the sequence, bits of a symbol
    i64 / u8 doc_id of each document; 1 where it is null
    u32      tokens of each document, its end id counted
    u32      expansion lengths of the rules, in tokens
    bits x 2 rules: the two symbols that a rule's symbol stands for
    bits     the sequence

With the expansion lengths a document is found in the sequence and decoded
without expanding what lies before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scholium.llm.bpe import default_path, encoder, raw_texts
from scholium.llm.common import place, text_of

END = 1
BLOCK_TOKENS = 1_000_000
#: Bytes of text per partition of the files, about.
PART_BYTES = 32 << 20
MAGIC = b"RPR2"
#: Pairs seen this often or more are replaced. A round takes those seen at least 1 / ``SHARE`` as often as its most frequent one.
MIN_COUNT, SHARE = 4, 16
_HALF = np.uint64(32)


def _ranked(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in ascending order, as left << 32 | right, and their places. Where a place still fits beside a pair, both are sorted as one number."""
    width, place = np.uint64(symbols.bit_length()), np.uint64(len(left).bit_length())
    if 2 * width + place > 64:
        keys = (left << _HALF) | right
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = np.sort((((left << width) | right) << place) | np.arange(len(left), dtype=np.uint64))
    pairs = both >> place
    return ((pairs >> width) << _HALF) | (pairs & ((np.uint64(1) << width) - np.uint64(1))), (both & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)


def re_pair(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): rule i has symbol terminals + i and stands for its two symbols.

    Of overlapping frequent pairs the more frequent is replaced and the other
    waits for the next round. No rule spans the end of a document, so a symbol
    that ends with END never starts a pair. A pair seen too seldom cannot become
    frequent unless one of its symbols is new, so only the other places are
    counted again.
    """
    x = ids.astype(np.uint64)
    rules = np.empty((0, 2), np.uint64)
    ends = np.zeros(terminals, bool)
    ends[END] = True
    live = ~ends[x[:-1]]
    while len(x) > 1:
        at = np.flatnonzero(live)
        keys, order = _ranked(x[at], x[at + 1], len(ends))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        often = counts >= MIN_COUNT
        if not often.any():
            break
        best = np.flatnonzero(often & (counts * SHARE >= counts.max()))
        best = best[np.argsort(-counts[best], kind="stable")]
        none = len(first)
        rank = np.full(none, none)
        rank[best] = np.arange(len(best))
        rank[~often] = -1
        mine = np.empty(len(at), np.int64)
        mine[order] = np.repeat(rank, counts)
        live[at[mine < 0]] = False
        chosen = (mine >= 0) & (mine < none)
        pairs, at, mine = keys[first[best]], at[chosen], mine[chosen]
        prio = np.full(len(x) + 1, none)
        prio[at + 1] = mine  # shifted by one: prio[0] stands before the text
        before, after = prio[at], prio[at + 2]
        fresh_run = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (mine[1:] != mine[:-1])]))
        odd = (np.arange(len(at)) - np.repeat(fresh_run, np.diff(np.append(fresh_run, len(at))))) % 2 == 1  # of one symbol: every other pair
        taken = (mine <= after) & ((mine < before) | ((mine == before) & ~odd))
        at, mine = at[taken], mine[taken]
        used, symbol = np.unique(mine, return_inverse=True)
        new = np.stack([pairs[used] >> _HALF, pairs[used] & np.uint64((1 << 32) - 1)], axis=1)
        base = terminals + len(rules)
        ends = np.concatenate([ends, ends[new[:, 1]]])
        rules = np.concatenate([rules, new])
        x[at] = (base + symbol).astype(np.uint64)
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        after_last = np.append(live, False)  # the place of the last symbol starts no pair
        x, live = x[keep], after_last[keep][:-1]
        live &= ~ends[x[:-1]]
    return rules, x


def _levels(rules: np.ndarray, terminals: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules that only use symbols before the range."""
    most, start = rules.max(axis=1).astype(np.int64) - terminals if len(rules) else np.zeros(0, np.int64), 0
    while start < len(rules):
        later = most[start:] >= start
        end = start + int(later.argmax()) if later.any() else len(rules)
        yield start, end
        start = end


def lengths_of(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Expansion lengths of the rules; a rule only uses symbols before its own."""
    out = np.ones(terminals + len(rules), np.int64)
    for i, j in _levels(rules, terminals):
        out[terminals + i : terminals + j] = out[rules[i:j, 0]] + out[rules[i:j, 1]]
    return out[terminals:].astype("<u4")


def to_bits(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, end to end."""
    return np.packbits(np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little").ravel(), bitorder="little").tobytes()


def from_bits(data: bytes, start: int, count: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8, (count * width + 7) // 8, start), count=count * width, bitorder="little").reshape(count, width)
    out = np.zeros((count, 4), np.uint8)
    out[:, : (width + 7) // 8] = np.packbits(bits, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4").astype(np.int64)


def pack(doc_ids: list, counts: list[int], ids: np.ndarray, terminals: int) -> bytes:
    rules, sequence = re_pair(ids, terminals)
    width = (terminals + len(rules)).bit_length()
    head = MAGIC + struct.pack("<5I", len(counts), terminals, len(rules), len(sequence), width)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], "u1")
    return b"".join([head, numbers.tobytes(), nulls.tobytes(), np.array(counts, "<u4").tobytes(), lengths_of(rules, terminals).tobytes(), to_bits(rules.ravel(), width), to_bits(sequence, width)])


class Block:
    """Reads a block's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n, self.terminals, r, s, width = struct.unpack_from("<5I", data, 4)
        at = 24

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        numbers, nulls = part("<i8", n), part("u1", n)
        self.doc_ids = [None if z else int(x) for x, z in zip(numbers, nulls, strict=True)]
        self.counts = part("<u4", n).astype(np.int64)
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), part("<u4", r).astype(np.int64)])
        self.rules = from_bits(data, at, 2 * r, width).reshape(r, 2)
        self.sequence = from_bits(data, at + (2 * r * width + 7) // 8, s, width)
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' expansions end to end, and where each starts."""
        if self._flat is None:
            starts = np.concatenate([[0], np.cumsum(self.lengths)])
            flat = np.empty(starts[-1], np.uint32)
            flat[: self.terminals] = np.arange(self.terminals)
            self._flat = flat, starts
            for i, j in _levels(self.rules, self.terminals):
                flat[starts[self.terminals + i] : starts[self.terminals + j]] = self.expand(self.rules[i:j].ravel())
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, starts = self._expansions()
        sizes = self.lengths[symbols]
        shift = starts[symbols] - (np.cumsum(sizes) - sizes)
        return flat[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document alone."""
        start = int(self.counts[:i].sum())
        upto = np.cumsum(self.lengths[self.sequence])
        first = int(np.searchsorted(upto, start, side="right"))
        last = int(np.searchsorted(upto, start + int(self.counts[i]), side="left"))
        return self.expand(self.sequence[first : last + 1])[start - (int(upto[first - 1]) if first else 0) :][: int(self.counts[i])]

    def documents(self):
        ids, at = self.expand(self.sequence), 0
        for doc_id, n in zip(self.doc_ids, self.counts.tolist(), strict=True):
            yield doc_id, ids[at : at + n]
            at += n


def write(docs: DataFrame, path: str, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the ids of all ``docs`` to ``path``, by ascending doc_id (null first; equal ones by hash of text, then text).

    Rows that share a doc_id, or have none, are spread over parts by the hash.
    """
    tokenizer = tokenizer or default_path()
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    parts = max(1, -(-(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // PART_BYTES))
    rows = texts.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")

    def blocks(batches):
        own, part, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, counts, kept, total = [], [], [], 0

        def made():
            data = pack(doc_ids, counts, np.concatenate(kept), len(own.tokens))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_docs": pa.array([len(counts)], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            names, at = batch.column("doc_id").to_pylist(), 0
            for ids, sizes in own.texts(raw_texts(batch)):
                ids, upto = np.insert(ids, np.cumsum(sizes), END), np.cumsum(sizes + 1)
                start, base = 0, 0
                while start < len(sizes):
                    enough = int(np.searchsorted(upto, base + block_tokens - total)) + 1  # the document that fills the block is its last
                    stop = min(enough, len(sizes))
                    doc_ids += names[at + start : at + stop]
                    counts += (sizes[start:stop] + 1).tolist()
                    kept.append(ids[base : upto[stop - 1]])
                    total, base, start = total + int(upto[stop - 1]) - base, int(upto[stop - 1]), stop
                    if total >= block_tokens:
                        yield made()
                        doc_ids, counts, kept, total, block = [], [], [], 0, block + 1
                at += len(sizes)
        if counts:
            yield made()

    rows.drop("hash").mapInArrow(blocks, "part int, block int, n_docs long, n_tokens long, data binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of all documents in the files."""
    blocks = spark.read.parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    heads = blocks.select("part", "block", "n_tokens").join(bases, "part")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")
    starts = heads.select("part", "block", (F.col("base") + within).alias("base"))

    def documents(batches):
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("data").to_pylist(), strict=True):
                ids, start, count, crc, lists = [], [], [], [], []
                for doc_id, x in Block(data).documents():
                    ids.append(doc_id)
                    start.append(base)
                    count.append(len(x))
                    crc.append(zlib.crc32(x.astype("<u4")))
                    base += len(x)
                    if with_ids:
                        lists.append(x.astype(np.int32))
                columns = [pa.array(c, pa.int64()) for c in (ids, start, count, crc)]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    joined = blocks.select("part", "block", "data").join(starts, ["part", "block"]).select("base", "data")
    return joined.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the ids of ``docs`` into the shared folder and reads the files back.

    One row per row of ``docs``. A null text is empty: its only id is END. Null
    doc_ids come first; repeated doc_ids and repeated rows are documents of
    their own, in the order of their texts' hashes. Other columns are not looked
    at. An empty table gives no rows.
    """
    path = place(docs.sparkSession, "token-ids")
    write(docs.select(F.col("doc_id").cast("long"), "text"), path, tokenizer)
    return read(docs.sparkSession, path)
