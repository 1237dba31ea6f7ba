"""Answers and their evidence: citations, grounding, fallbacks, screening, a scripted judge."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from scholium.functions import safety
from scholium.functions.text import first_chars, tokenize
from scholium.operators.evaluation import overlap_grade

# Passages and characters of an extractive answer, evidence that grounds a turn, longest question.
EXTRACT_PASSAGES, EXTRACT_CHARS = 3, 400
MIN_EVIDENCE, MIN_RERANK = 1, 0.0
QUESTION_CHARS = 2000
SUPPORTED = 0.6

_GROUP, _ID, _BETWEEN = re.compile(r"\[([^\]]*)\]"), re.compile(r"S\d+"), re.compile(r"[,\s]+")


def _without(text: str, available: set[str]) -> str:
    def bracket(found: re.Match[str]) -> str:
        ids = [x for x in _BETWEEN.split(found[1].strip()) if _ID.fullmatch(x)]
        if not ids:
            return found[0]
        real = list(dict.fromkeys(x for x in ids if x in available))
        return f"[{', '.join(real)}]" if real else ""

    return _GROUP.sub(bracket, text)


@F.pandas_udf(StringType())
def without_invented(text: pd.Series, available: pd.Series) -> pd.Series:
    """The text without ids in brackets that are not available; brackets that hold no id are prose."""
    return pd.Series([None if t is None else _without(t, set(a if a is not None else ())) for t, a in zip(text, available, strict=True)], dtype=object)


def extractive(context: DataFrame) -> DataFrame:
    """query_id, answer of the first passages (citation_id, place, title, page, content), each with its id."""
    where = F.when(F.col("page").isNotNull(), F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise("")
    line = F.concat(F.lit("["), "citation_id", F.lit("] "), "title", where, F.lit(": "), first_chars(F.col("content"), EXTRACT_CHARS))
    lines = F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))
    return context.where(F.col("place") <= EXTRACT_PASSAGES).groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("answer"))


def used_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """query_id, place, citation_id, chunk_id: rows of the context that an answer's ``cited`` names, in that order."""
    named = answers.select("query_id", F.posexplode("cited").alias("place", "citation_id"))
    return named.join(context.select("query_id", "citation_id", "chunk_id"), ["query_id", "citation_id"]).select("query_id", "place", "citation_id", "chunk_id")


def citation_concepts(passages: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, citation_id, concepts: candidates on an edge that names the passage's chunk or document.

    Two equi-joins, not one with OR. A passage without any has an empty array.
    """
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("concept_id"), "chunk_id", "document_id").join(candidates.select("concept_id").distinct(), "concept_id", "left_semi")
    by = [passages.select("query_id", "citation_id", c).join(ends.select(c, "concept_id").distinct(), c).select("query_id", "citation_id", "concept_id") for c in ("chunk_id", "document_id")]
    found = by[0].unionByName(by[1]).groupBy("query_id", "citation_id").agg(F.sort_array(F.collect_set("concept_id")).alias("concepts"))
    empty = F.array().cast(found.schema["concepts"].dataType)
    return passages.select("query_id", "citation_id").distinct().join(found, ["query_id", "citation_id"], "left").withColumn("concepts", F.coalesce("concepts", empty))


def grounding(evidence: DataFrame, resolvable: DataFrame, least: int = MIN_EVIDENCE, floor: float = MIN_RERANK) -> DataFrame:
    """turn_id, grounded, evidence_count, max_rerank_score.

    A row without a rerank score counts as evidence. A turn in ``resolvable`` has
    a citation that resolves and is grounded without any.
    """
    counts = F.col("rerank_score").isNull() | (F.col("rerank_score") >= floor)
    by = evidence.groupBy("turn_id").agg(F.sum(counts.cast("long")).alias("evidence_count"), F.max("rerank_score").alias("max_rerank_score"))
    known = resolvable.select("turn_id").distinct().withColumn("_resolves", F.lit(True))
    both = by.join(known, "turn_id", "full_outer").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
    return both.select("turn_id", ((F.col("evidence_count") >= least) | F.coalesce("_resolves", F.lit(False))).alias("grounded"), "evidence_count", "max_rerank_score")


def screened(questions: DataFrame, encoded: bool = True, most: int = QUESTION_CHARS) -> DataFrame:
    """Adds verdict (too_long, refuse, sanitize, allow) and asked, the form that may go on (null if none)."""
    out = safety.with_signals(questions, encoded=encoded)
    verdict = F.when(F.length("text") > most, "too_long").otherwise(F.col("level"))
    asked = F.when(F.col("verdict") == "allow", F.col("text")).when(F.col("verdict") == "sanitize", safety.without_signals(F.col("text")))
    return out.withColumn("verdict", verdict).withColumn("asked", asked)


def validated(outputs: DataFrame, schema: str | None = None) -> DataFrame:
    """Adds clean (secrets and prompt echo cut), valid and degraded; with ``schema`` the text must be such JSON."""
    redacted = safety.redacted(F.col("text"))
    clean = safety.without_prompt_echo(redacted)
    valid = F.lit(True) if schema is None else F.from_json("clean", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})["_broken"].isNull() & F.col("clean").rlike(r"^\s*\{")
    out = outputs.withColumn("clean", clean).withColumn("valid", valid)
    marks = F.when(clean != redacted, F.lit("system_prompt_leak")), F.when(F.size(safety.secret_kinds(F.col("text"))) > 0, F.lit("secret_redacted")), F.when(~F.col("valid"), F.lit("output_invalid"))
    return out.withColumn("degraded", F.array_compact(F.array(*marks)))


def evidence_rows(ranked: DataFrame) -> DataFrame:
    """Ranked passages as evidence: the id S<rank>, the passage's columns, arrival in order of rank."""
    return ranked.withColumn("citation_id", F.concat(F.lit("S"), F.col("final_rank").cast("string"))).withColumn("seq", F.col("final_rank"))


# ---- scripted judge ----------------------------------------------------------


def overlap_graded(expected: Column, answer: Column) -> Column:
    """1 to 5 by the share of the expected text's terms that the answer has; 1 where none is expected."""
    terms = F.array_distinct(tokenize(expected))
    share = F.size(F.array_intersect(terms, tokenize(answer))) / F.size(terms)
    return F.when(F.size(terms) == 0, 1).otherwise(overlap_grade(share))


def supported_claims(answers: DataFrame) -> DataFrame:
    """answer_id, n_statements, n_supported of (text, context): sentences most of whose terms the context has."""
    sentences = answers.select("answer_id", F.array_distinct(tokenize(F.col("context"))).alias("known"), F.explode_outer(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")).alias("sentence"))
    marked = sentences.withColumn("terms", tokenize(F.col("sentence")))
    hits = F.size(F.filter("terms", lambda t: F.array_contains("known", t)))
    held = F.col("sentence").isNotNull() & (F.size("terms") > 0) & (hits / F.size("terms") >= SUPPORTED)
    return marked.groupBy("answer_id").agg(F.count("sentence").alias("n_statements"), F.sum(F.coalesce(held, F.lit(False)).cast("long")).alias("n_supported"))
