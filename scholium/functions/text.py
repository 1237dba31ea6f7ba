"""Text analysis as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# The stop words of the index. Changing one is a re-index.
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between "
    "both but by can cannot could couldn't did didn't do does doesn't doing don't down during each few for from further "
    "had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's "
    "i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on "
    "once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some "
    "such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've "
    "this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when "
    "when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've "
    "your yours yourself yourselves"
).split()
#: A token: letters, digits and ``-_.+``, from a letter or digit to the last that is none of ``-_.``.
TOKEN_PATTERN = r"[a-z0-9](?:[a-z0-9\-_.+]*[a-z0-9+])?"
#: Characters beyond which a text may change under NFKC: ASCII, Western European letters, dashes, quotes.
_STEADY = "^[\\x00-\\x7f\\xc0-\\xff\\u0152\\u0153\\u2013\\u2014\\u2018-\\u201e\\u2022\\u20ac]*$"
SLUG_PATTERN = r"^[a-z0-9]+(-[a-z0-9]+)*$"
# Phrases by intent; the first family with a phrase in the question wins.
INTENTS = (
    ("planner", ("study plan", "learning plan", "roadmap", "learning path", "revision plan", "plan my", "what should i study", "schedule for")),
    ("assessment", ("quiz me", "quiz", "test me", "practice question", "practice questions", "exam question", "grade my", "evaluate my answer", "mark my", "assess my")),
    ("recommender", ("recommend", "resources", "resource", "where can i learn", "what should i read", "book to read", "video", "course to take")),
    ("progress", ("how am i doing", "my progress", "how much have i", "weak concept", "weak concepts", "mastery", "what should i revise", "where am i struggling")),
)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def may_change(text: Column) -> Column:
    return ~text.rlike(_STEADY)


def nfkc(text: Column) -> Column:
    """NFKC; only texts that it may change go through Python."""
    return F.coalesce(_nfkc(F.when(may_change(text), text)), text)


@F.pandas_udf(StringType())
def casefolded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def tokenize(text: Column, normalise: bool = True) -> Column:
    """Terms in order: NFKC, lower case, tokens without trailing ``-_.`` (``c++`` keeps its plus)."""
    return F.regexp_extract_all(F.lower(nfkc(text) if normalise else text), F.lit(TOKEN_PATTERN), F.lit(0))


def is_term(token: Column) -> Column:
    return ~token.isin(*STOPWORDS)


def index_terms(tokens: Column) -> Column:
    """Tokens that are no stop words, repeats kept; queries are analysed the same way."""
    return F.filter(tokens, is_term)


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(casefolded(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_slug(slug: Column) -> Column:
    return slug.rlike(SLUG_PATTERN)


def folded(text: Column) -> Column:
    """White space collapsed, case removed: the form in which quotes are compared."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def _cut(text: Column, limit: int, least: float, ellipsis: str) -> Column:
    head = F.rtrim(F.substring(text, 1, limit))
    stop = F.length(head) - F.length(F.regexp_extract(head, r"([^.!?]*)$", 1))
    return F.when(F.length(text) <= limit, text).when(stop >= least, F.trim(head.substr(F.lit(1), stop))).otherwise(F.concat(F.rtrim(head), F.lit(ellipsis)))


def bounded_quote(text: Column, limit: int = 240) -> Column:
    """At most ``limit`` characters, ended at a sentence if that leaves a third of them."""
    return _cut(F.trim(F.regexp_replace(text, r"\s+", " ")), limit, limit / 3, "...")


def first_chars(text: Column, limit: int) -> Column:
    """The first characters, ended at a sentence beyond half of them."""
    return _cut(F.trim(F.regexp_replace(text, r"\s+", " ")), limit, limit // 2 + 2, "...")


def title_of(text: Column, limit: int = 80) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/]*@)?([^:/?#]+)", 1))


def with_trust(df: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, domain and trust by the longest listed domain that the host ends with.

    A host's suffixes are exploded (as many as it has labels), so the match is an
    equi-join and not a comparison of every host with every domain.
    """
    hosts = df.select(host_of(F.col(url)).alias("host")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.select("host", F.explode(suffixes).alias("domain")).join(domains, "domain")
    best = found.groupBy("host").agg(F.max_by(F.struct("domain", "trust"), F.length("domain")).alias("best"))
    return df.withColumn("host", host_of(F.col(url))).join(best, "host", "left").select("*", "best.domain", "best.trust").drop("best")


def intent(question: Column) -> Column:
    lowered = F.lower(question)
    out = F.lit("tutor")
    for name, phrases in reversed(INTENTS):
        out = F.when(reduce(lambda a, b: a | b, (lowered.contains(p) for p in phrases)), name).otherwise(out)
    return out


def rendered(template: Column, values: Column) -> Column:
    """A template with ``{name}`` replaced by a map's values; ``{{`` and ``}}`` are braces. A name that the map lacks is an error.

    Values are put in once and never read as templates themselves.
    """
    token = r"\{\{|\}\}|\{(\w+)\}"
    between = F.split(template, token, -1)
    name = lambda t: F.substr(t, F.lit(2), F.length(t) - 2)
    value = lambda t: F.coalesce(F.element_at(values, name(t)), F.raise_error(F.concat(F.lit("no value for "), t)))
    said = F.transform(F.regexp_extract_all(template, F.lit(token), F.lit(0)), lambda t: F.when(t == "{{", "{").when(t == "}}", "}").otherwise(value(t)))
    return F.array_join(F.zip_with(between, said, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def fingerprint(*parts: Column) -> Column:
    """Twelve hex digits of a payload."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)
