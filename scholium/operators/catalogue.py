"""The resource catalogue: substring search over several columns by a stored gram index, and what covers a learner's gaps.

A text holds a pattern only if it holds every run of three characters of it. So a
pattern is looked up by the one of its runs that fewest resources have; an
equi-join gives candidates and the whole pattern decides. Patterns of one or two
characters are looked up as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from scholium.operators.lexical import top_k
from scholium.store import small, written

SEARCHED = ("title", "description", "provider")
GRAM = 3
#: Questions without a pattern that are sent to every task.
BLANK_ROWS = 10_000
#: Rows of (resource, concept) that one request for covering resources looks at.
COVERAGE_ROWS = 400


def runs(text: Column, size: int | Column) -> Column:
    """Distinct runs of ``size`` characters."""
    size = size if isinstance(size, Column) else F.lit(size)
    n = F.char_length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def like_pattern(query: Column, escape: str = "\\") -> Column:
    """The pattern that holds ``query`` as it is written: its wildcards stand for themselves."""
    for c in (escape, "%", "_"):
        query = F.replace(query, F.lit(c), F.lit(escape + c))
    return F.concat(F.lit("%"), query, F.lit("%"))


@dataclass
class Catalogue:
    """Resources (resource_id, title, url, and what is searched and filtered by) with their written grams (gram, resource_id) and the grams' frequencies."""

    resources: DataFrame
    grams: DataFrame
    frequencies: DataFrame
    searched: tuple[str, ...] = SEARCHED

    def candidates(self, asked: DataFrame) -> DataFrame:
        """query_id, resource_id of the resources that have the rarest gram of a question (query_id, pattern: lower case, not empty).

        A gram that nobody has is the rarest of all, and leaves nothing.
        """
        size = F.least(F.char_length("pattern"), F.lit(GRAM))
        parts = written(asked.select("query_id", F.explode(runs(F.col("pattern"), size)).alias("gram")), "asked-grams")
        known = parts.join(self.frequencies.join(small(parts.select("gram").distinct()), "gram", "left_semi"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rarest = written(known.groupBy("query_id").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram")), "rarest-grams")
        return self.grams.join(small(rarest), "gram").select("query_id", "resource_id")

    def search(self, questions: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
        """query_id, resource_id, title, url, place, total: one page of each question's resources, by title, then url.

        ``questions``: query_id, query, and the columns that have to be equal, where
        they are not null. A blank query asks for all. The query is searched for as
        it is written, without regard to case; ``total`` counts all that are found.
        """
        equal = [c for c in questions.columns if c not in ("query_id", "query")]
        asked = written(questions.withColumn("pattern", F.lower(F.trim(F.coalesce("query", F.lit(""))))).drop("query"), "asked")
        wanted = asked.select("query_id", "pattern", *(F.col(c).alias(f"_{c}") for c in equal))
        some = self.candidates(asked.where("pattern <> ''")).join(small(wanted), "query_id").join(self.resources, "resource_id")
        said = F.lit(False)
        for c in self.searched:
            said = said | F.coalesce(F.contains(F.lower(c), F.col("pattern")), F.lit(False))
        found = some.where(said)
        blank = wanted.where("pattern = ''")
        if not blank.isEmpty():  # these do ask for every row
            found = found.unionByName(self._unasked(blank, equal).select(found.columns))
        for c in equal:
            found = found.where(F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)))
        found = written(found.select("query_id", "resource_id", "title", "url").distinct(), "found-resources")
        totals = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
        page = top_k(found, ["query_id"], [F.asc("title"), F.asc("url"), F.asc("resource_id")], offset + limit, "place").where(F.col("place") > offset)
        return page.join(small(written(totals, "totals")), "query_id")

    def _unasked(self, blank: DataFrame, equal: list[str]) -> DataFrame:
        """Rows for questions without a pattern, which each get all that they do not filter out, as they ask."""
        same = F.lit(True)
        for c in equal:
            same = same & (F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)))
        return self.resources.join(F.broadcast(blank) if blank.count() <= BLANK_ROWS else blank, same)


def indexed(resources: DataFrame, searched: tuple[str, ...] = SEARCHED) -> Catalogue:
    """A catalogue over ``resources``; a resource's grams of one, two and three characters are written once."""
    each = [runs(F.lower(F.coalesce(c, F.lit(""))), size) for c in searched for size in (1, 2, GRAM)]
    rows = written(resources, "resources")
    grams = rows.select("resource_id", F.explode(F.array_distinct(F.concat(*each))).alias("gram"))
    grams = written(grams.repartition("gram").sortWithinPartitions("gram"), "resource-grams")
    return Catalogue(rows, grams, written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-frequencies"), searched)


def covering(gaps: DataFrame, covers: DataFrame, resources: DataFrame, row_limit: int = COVERAGE_ROWS) -> DataFrame:
    """user_id, resource_id, url, slugs: what covers a learner's gaps (user_id, slug), by url.

    Of the rows (resource, concept) that match, the first ``row_limit`` by url and
    slug are looked at; ``slugs`` are the concepts among them. No learner sees more
    than the first ``row_limit`` rows of a concept, so each concept is cut to these
    before it meets the learners; they carry numbers in place of the rows.
    """
    asked = gaps.where(F.coalesce("slug", F.lit("")) != "").select("user_id", "slug").distinct()
    every = covers.select("resource_id", "slug").distinct().join(resources.select("resource_id", "url"), "resource_id")
    order = ["url", "slug", "resource_id"]
    first = written(top_k(every, ["slug"], [F.asc(c) for c in order], row_limit, "_n").drop("_n"), "first-covers")
    placed = written(first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed-covers")
    listed = placed.groupBy("slug").agg(F.collect_list("_at").alias("_places"))
    seen = asked.repartition("user_id").join(small(listed), "slug").groupBy("user_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("_places"))), 1, row_limit).alias("_places"))
    rows = seen.select("user_id", F.explode("_places").alias("_at")).join(small(placed), "_at")
    return rows.groupBy("user_id", "resource_id", "url").agg(F.sort_array(F.collect_set("slug")).alias("slugs"))
