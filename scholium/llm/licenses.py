"""License scans by ordered signature rules.

A text becomes its lower-cased words with one space between them. A rule is tried
only where the text has the rule's keyword; all keywords are looked up at once. Each
match is a detection over an interval of words. A detection is suppressed if another
of the same or a stronger kind holds its whole interval: of those over the same
interval the earlier rule stays. So "GNU General Public License, version 3" is one
license, not three, while a license named beside it stays.

Everything is column expressions. Only detections are shuffled, by row; they are
ordered within their row, and one running maximum of ends per kind tells in a single
pass which are held, so no two detections are compared as a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scholium.llm.common import text_of, written
from scholium.llm.license_rules import KINDS, Rule, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose label a text has whatever the rules say.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_KEYWORD = "license"


def bounded(regex: str) -> str:
    """The regex over whole words of a text as ``as_words`` gives it."""
    return f"(?<= )(?:{regex})(?= )"


def as_words(text: Column) -> Column:
    """Words with one space between them and around them all."""
    lowered = F.translate(text, UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, BETWEEN, " ")), F.lit(" "))


def spaces(column: Column) -> Column:
    return F.octet_length(column) - F.octet_length(F.replace(column, F.lit(" ")))


def _rule_list(ordered: list[Rule]) -> Column:
    kinds = list(KINDS)
    return F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(kinds.index(r.kind)).alias("kind"), F.lit(r.keyword).alias("keyword"), F.lit(bounded(r.regex)).alias("regex")) for i, r in enumerate(ordered)))


def scanned(docs: DataFrame, ordered: list[Rule]) -> DataFrame:
    """uid, doc_id, n_words, n_base, first_word, last_word, base (labels), found: one row per row of ``docs``.

    ``found`` has, for each rule that matches, the numbers of words between its
    matches and the lengths of the matches in words: however long the text, a rule
    leaves two lists of small numbers.
    """
    keywords = F.array(*map(F.lit, sorted({BASE_KEYWORD, *(r.keyword for r in ordered)})))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", as_words(text_of()).alias("words"))
    rows = rows.withColumns({
        "n_words": F.when(F.col("words") == "  ", 0).otherwise(spaces(F.col("words")) - 1).cast("long"),
        "keys": F.array_intersect(keywords, F.split("words", " "))})
    base = bounded("|".join(BASE))
    rows = rows.withColumn("base_gaps", F.when(F.array_contains("keys", BASE_KEYWORD), F.split("words", base, -1)))
    rows = rows.withColumn("n_base", F.coalesce(F.array_size("base_gaps") - 1, F.lit(0)).cast("long"))
    some = F.col("n_base") > 0
    rows = rows.withColumn("base_hits", F.when(some, F.regexp_extract_all("words", F.lit(base), F.lit(0))))

    tried = F.filter(_rule_list(ordered), lambda r: F.array_contains("keys", r["keyword"]))
    tried = F.transform(tried, lambda r: F.struct(
        r["rule"].alias("rule"), r["kind"].alias("kind"), r["regex"].alias("regex"),
        F.transform(F.split("words", r["regex"], -1), lambda piece: spaces(piece) - 1).alias("gaps")))
    found = F.transform(F.filter(tried, lambda r: F.size(r["gaps"]) > 1), lambda r: F.struct(
        r["rule"].alias("rule"), r["kind"].alias("kind"), r["gaps"].alias("gaps"),
        F.transform(F.regexp_extract_all("words", r["regex"], F.lit(0)), lambda match: spaces(match) + 1).alias("lengths")))

    labels = F.array_compact(F.array(*(F.when(F.array_contains("base_hits", phrase), F.lit(label)) for phrase, label in BASE.items())))
    after = spaces(F.element_at("base_gaps", -1)) - 1
    last = F.col("n_words") - after - (spaces(F.element_at("base_hits", -1)) + 1)
    return rows.select(
        "uid", "doc_id", "n_words", "n_base", F.when(some, spaces(F.element_at("base_gaps", 1)) - 1).cast("long").alias("first_word"), F.when(some, last).cast("long").alias("last_word"),
        F.when(some, labels).otherwise(F.array().cast("array<string>")).alias("base"), F.when(F.size("keys") > 0, found).alias("found"))


def detections(rows: DataFrame) -> DataFrame:
    """uid, rule, kind, start, end (words, end excluded), kept: every match of a rule in ``rows`` of ``scanned``."""
    each = rows.where("size(found) > 0").select("uid", F.explode("found").alias("f"))
    spans = F.arrays_zip(F.slice("f.gaps", F.lit(1), F.size("f.lengths")).alias("gap"), F.col("f.lengths").alias("length"))
    each = each.select("uid", "f.rule", "f.kind", F.posexplode(spans).alias("pos", "span")).repartition("uid")
    so_far = Window.partitionBy("uid", "rule").orderBy("pos")
    end = F.sum(F.col("span.gap") + F.col("span.length")).over(so_far)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("span.length"))
    # what comes before in this order starts no later; it holds this interval just if it ends no earlier
    before = Window.partitionBy("uid").orderBy("start", F.desc("end"), "kind", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.array(*(F.max(F.when(F.col("kind") <= k, F.col("end"))).over(before) for k in range(len(KINDS))))
    held = F.coalesce(F.get(reach, F.col("kind")) >= F.col("end"), F.lit(False))
    return each.select("uid", "rule", "kind", "start", "end", (~held).alias("kept"))


def scan(docs: DataFrame, ordered: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of ``docs``.

    Labels are those of kept detections and the base ones; the score is how sure
    the surest kept detection is (0 without one). A null or empty text has no words
    and empty labels; null and repeated doc_ids and repeated rows keep their own
    rows; other columns are not looked at. An empty table gives no rows.
    """
    ordered = rules() if ordered is None else ordered
    rows = written(scanned(docs, ordered), "license-rows")
    label = F.element_at(F.array(*(F.lit(r.label) for r in ordered)), F.col("rule") + 1)
    sure = F.element_at(F.array(*map(F.lit, KINDS.values())), F.col("kind") + 1)
    kept = detections(rows).where("kept").groupBy("uid").agg(F.collect_set(label).alias("own"), F.max(sure).alias("sure"))
    none = F.array().cast("array<string>")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return rows.join(kept, "uid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("own", none))).alias("labels"), F.coalesce("sure", F.lit(0.0)).alias("score"))
