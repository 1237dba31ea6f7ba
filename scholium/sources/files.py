"""Readers and writers: uploads, Markdown corpora, golden questions, reports, seeds."""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib
import uuid
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scholium.store import shared_folder

GOLDEN = "id string, question string, expected_answer string, expected_sources array<string>, category string, notes string"
#: Bytes of names and texts that one task of a corpus' hash reads.
PIECE_BYTES = 256 << 20
# File types, and parts of names that tell a source type, first hit wins.
TEXT_TYPES, BINARY_TYPES = (".txt", ".md", ".markdown"), (".pdf", ".docx")
SOURCE_HINTS = (
    (("syllabus", "syllabi", "curriculum"), "syllabus"), (("slide", "slides", "deck", "keynote"), "slide"), (("paper", "arxiv", "journal", "article", "preprint"), "paper"),
    (("book", "chapter", "textbook", "monograph"), "book"), (("lecture", "lect", "class", "tutorial", "seminar"), "lecture"), (("note", "notes", "summary", "cheatsheet", "cheat-sheet"), "notes"),
    (("doc", "docs", "documentation", "manual", "readme", "guide", "reference", "spec"), "documentation"),
)


def source_type(name: Column) -> Column:
    low, out = F.lower(name), F.lit("other")
    for parts, kind in reversed(SOURCE_HINTS):
        out = F.when(reduce(lambda a, b: a | b, (low.contains(p) for p in parts)), kind).otherwise(out)
    return out


def uploads(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files below ``path``; a rejected one says why."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return validated(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content"), most_bytes)


def validated(files: DataFrame, most_bytes: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    ext = F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))
    magic = F.when(ext == ".pdf", F.substring("content", 1, 5) == F.lit(b"%PDF-")).when(ext == ".docx", F.substring("content", 1, 4) == F.lit(b"PK\x03\x04")).otherwise(True)
    reason = F.when(~ext.isin(*TEXT_TYPES, *BINARY_TYPES), "type").when(F.length("content") == 0, "empty").when(F.length("content") > most_bytes, "size").when(~magic, "magic")
    marked = files.withColumn("extension", ext).withColumn("rejected", reason)
    return marked.where("rejected is null").drop("rejected").withColumn("source_type", source_type(F.col("filename"))), marked.where("rejected is not null").drop("content")


def text_pages(files: DataFrame) -> DataFrame:
    """filename, page, text of plain text and Markdown: one page, without a byte order mark."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.where(F.col("extension").isin(*TEXT_TYPES)).select("filename", F.lit(1).alias("page"), text.alias("text"))


def markdown_corpus(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("filename"), F.col("value").alias("text"))


class _Sha256:
    """SHA-256 whose state can be handed on: OpenSSL's, which hashlib itself calls."""

    SIZE = 112  # eight words of state, the length in bits, a block that is not full, and how full it is

    def __init__(self, state: bytes | None = None):
        self.lib, self.state = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(state or b"", 2 * self.SIZE)
        if state is None:
            self.lib.SHA256_Init(self.state)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.state, data, ctypes.c_size_t(len(data)))

    def so_far(self) -> bytes:
        return self.state.raw[: self.SIZE]

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.so_far(), 2 * self.SIZE))
        return out.raw.hex()


def _can_be_handed_on() -> bool:
    """Whether this Python's hashlib uses a shared OpenSSL that still has the functions."""
    try:
        state = _Sha256()
        state.update(b"ab")
        state = _Sha256(state.so_far())
        state.update(b"c" * 100)
        return state.hexdigest() == hashlib.sha256(b"ab" + b"c" * 100).hexdigest()
    except (AttributeError, OSError, TypeError):
        return False


def corpus_hash(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row: SHA-256 of the stream of name, zero byte, content, zero byte, in order of name.

    A null name is left out, a null text is empty, no rows give null. Equal names
    stand in order of their texts. One stream has one hash state, so rows are dealt out by
    ranges of names, in pieces of about ``piece_bytes``; one task after the other hashes a
    piece, in constant memory, and hands its state (112 bytes) to the next.
    ``ranged_corpus_hash`` has all ranges hashed at once, and is another hash.
    """
    rows = docs.select("filename", "text").where("filename is not null")
    size = rows.agg(F.sum(F.octet_length("filename") + F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    pieces = -(-size // piece_bytes) if _can_be_handed_on() else 1

    def hashed(piece: DataFrame, state: bytes | None, last: bool) -> DataFrame:
        def fold(batches):
            own, some = (_Sha256(state) if pieces > 1 else hashlib.sha256()), state is not None
            for batch in batches:
                for name, text in zip(batch.column("filename").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    own.update(f"{name}\0{text or ''}\0".encode())
                    some = True
            out = pa.array([own.hexdigest() if some else None]) if last else pa.array([own.so_far() if some else None], pa.binary())
            yield pa.RecordBatch.from_arrays([out.cast(pa.string()) if last else out], ["corpus_hash"])

        folded = piece.sortWithinPartitions("filename", "text").mapInArrow(fold, "corpus_hash string" if last else "corpus_hash binary")
        alone = F.lit(_Sha256(state).hexdigest() if state else None) if last else F.lit(state)  # a piece may have no rows
        return folded.agg(F.coalesce(F.max("corpus_hash"), alone).alias("corpus_hash"))

    if pieces < 2:
        return hashed(rows.repartition(1), None, True)
    path, state = f"{shared_folder(docs.sparkSession)}/hash-pieces-{uuid.uuid4().hex}", None
    rows.repartitionByRange(pieces, "filename").withColumn("piece", F.spark_partition_id()).write.partitionBy("piece").parquet(path)
    dealt = docs.sparkSession.read.schema("filename string, text string, piece int").parquet(path)
    for i in range(pieces):
        piece = dealt.where(F.col("piece") == i).select("filename", "text").coalesce(1)
        if i == pieces - 1:
            return hashed(piece, state, True)
        state = hashed(piece, state, False).first()[0]
        state = state and bytes(state)


def ranged_corpus_hash(docs: DataFrame, ranges: int = 256) -> DataFrame:
    """One row: a hash over a hash of each range of names, in order of name within it.

    A name's range is the start of its own hash, so that it does not depend on the
    cluster; tasks hash sorted rows as they pass, and only ``ranges`` hashes are gathered.
    A null name or text is not the same as an empty one.
    """
    field = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    each = docs.select("filename", F.sha2(F.concat(field("filename"), F.lit("\x00"), field("text"), F.lit("\x00")), 256).alias("h"))
    each = each.withColumn("range", F.pmod(F.conv(F.substring(F.sha2(F.coalesce("filename", F.lit("")), 256), 1, 8), 16, 10).cast("long"), F.lit(ranges)).cast("int"))

    def fold(frames):
        at, state = None, None
        for pdf in frames:
            for r, h in zip(pdf["range"], pdf["h"], strict=True):
                if r != at:
                    if state is not None:
                        yield pd.DataFrame({"range": [at], "h": [state.hexdigest()]})
                    at, state = r, hashlib.sha256()
                state.update(h.encode())
        if state is not None:
            yield pd.DataFrame({"range": [at], "h": [state.hexdigest()]})

    parts = each.repartition(ranges, "range").sortWithinPartitions("range", "filename", "h").mapInPandas(fold, "range int, h string")
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "h"))), lambda x: F.concat(x["range"].cast("string"), F.lit(":"), x["h"])), "\n"), 256).alias("corpus_hash"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from JSON lines; raises on malformed or contradictory rows."""
    rows = spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)
    n, ids, wrong = rows.agg(F.count(F.lit(1)), F.countDistinct("id"), F.sum(((F.col("category") == "unanswerable") != (F.size("expected_sources") == 0)).cast("int"))).first()
    if not n or ids != n or wrong:
        raise ValueError(f"golden questions: {n} rows, {ids} ids, {wrong or 0} whose sources contradict their category")
    return rows


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def text_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def missing_seeds(catalogue: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds to append: those whose url the catalogue lacks; what it has is never overwritten."""
    return seeds.join(catalogue.select("url"), "url", "left_anti").dropDuplicates(["url"])


def replaced_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk table after the documents in ``new`` were ingested again."""
    keys = ["tenant_id", "document_id"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def first_copies(docs: DataFrame) -> DataFrame:
    """Adds sha256 and reused: of one content in a tenant's course the first row is new, the rest are reused."""
    first = Window.partitionBy("tenant_id", "course_id", "sha256").orderBy("document_id")
    return docs.withColumn("sha256", F.sha2(F.col("text"), 256)).withColumn("reused", F.row_number().over(first) > 1)
