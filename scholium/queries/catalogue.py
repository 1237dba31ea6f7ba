"""Catalogue search and what covers a learner's gaps."""

from pyspark.sql import functions as F

from scholium.operators import catalogue as C
from scholium.queries.domain import REC_SQL, _rec
from scholium.queries.tables import table
from scholium.registry import query

RESOURCES_SQL = r"""res AS (SELECT page_id AS resource_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<p>([^<]*)</p>', 1) AS description, regexp_extract(url, '://([^/]+)', 1) AS provider, url,
    ['official', 'academic', 'community', 'other'][1 + page_id % 4] AS trust FROM pages),
  asked AS (SELECT item_id AS query_id, CASE item_id % 7 WHEN 1 THEN 'Example.' WHEN 2 THEN '%' WHEN 3 THEN 'a_e' WHEN 4 THEN '  ' WHEN 5 THEN 'o' ELSE list_extract(string_split(text, ' '), 3) END AS query,
    CASE WHEN item_id % 3 = 0 THEN 'official' END AS trust FROM benchmark),
  found AS (SELECT query_id, resource_id, title, url FROM asked a JOIN res r ON (a.trust IS NULL OR a.trust = r.trust) AND (trim(query) = '' OR contains(lower(title), lower(trim(query))) OR contains(lower(description), lower(trim(query))) OR contains(lower(provider), lower(trim(query)))))"""


def _catalogue(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(
        k.alias("resource_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<p>([^<]*)</p>", 1).alias("description"), F.regexp_extract("url", "://([^/]+)", 1).alias("provider"), "url",
        F.element_at(F.array(*map(F.lit, ("official", "academic", "community", "other"))), (1 + k % 4).cast("int")).alias("trust"))
    i = F.col("item_id")
    said = F.when(i % 7 == 1, "Example.").when(i % 7 == 2, "%").when(i % 7 == 3, "a_e").when(i % 7 == 4, "  ").when(i % 7 == 5, "o").otherwise(F.get(F.split("text", " "), F.lit(2)))
    asked = table(spark, d, "benchmark").select(i.alias("query_id"), said.alias("query"), F.when(i % 3 == 0, "official").alias("trust"))
    return rows, asked


@query("catalogue_pages", f"WITH {RESOURCES_SQL} SELECT query_id, resource_id, place, total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY title, url, resource_id) AS place, count(*) OVER (PARTITION BY query_id) AS total FROM found) WHERE place > 10 AND place <= 30")
def catalogue_pages(spark, d):
    """The second half page of every question: patterns with wildcards as they are written, blank ones, filters."""
    rows, asked = _catalogue(spark, d)
    return C.indexed(rows).search(asked, limit=20, offset=10).select("query_id", "resource_id", "place", "total")


@query("covering_users", f"{REC_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY url, slug, resource_id) AS n FROM gaps JOIN cov USING (slug) JOIN res USING (resource_id)) SELECT user_id, resource_id, url, list_sort(list(slug)) AS slugs FROM m WHERE n <= 50 GROUP BY ALL")
def covering_users(spark, d):
    """What covers the gaps of every learner, of the first 50 rows that match."""
    resources, covers, gaps = _rec(spark, d)
    return C.covering(gaps, covers, resources, 50)
