"""URL filters with dated lists: validity intervals and an as-of join.

A list entry is (pattern, category, action, at): `add` makes the pattern active from `at` on, `remove` ends it at that
moment. Events of a pattern and category become disjoint intervals [since, until). A pattern is a host name, which
holds for the host and all its subdomains, or host/path, which holds for that path and all below it.

Each capture gives one key for every suffix of its host and every prefix of its path (up to the parts that the longest
pattern has, so a long URL gives few), and is joined with intervals by
key and month, so a capture is compared only with intervals that touch its month; the interval must hold the fetch
time. Verdicts depend on URL and fetch time alone: they are made once for each such pair. The list's side is broadcast
only if counted small; else the join shuffles by (key, month), and adaptive execution splits hot keys.

Defined results: a null or unparsable URL, or a null fetch time, has no active entry and is allowed. Repeated captures
each get their row; without captures there are none. Repeated list events count once; a repeated `add` changes nothing; of events at one moment `add`
has the last word. Entries with a null pattern, category or time are ignored. Extra columns are kept, those with the
outputs' names are replaced. Host names and patterns compare in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import aside, cut, keyed_join, salted_join, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
OUTPUTS = ("host", "n_active", "categories", "patterns", "allowed")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, since, until) of a table of list events; until is null while the entry is active."""
    known = entries.where("pattern IS NOT NULL AND category IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    events = known.groupBy(F.lower("pattern").alias("pattern"), "category", "at").agg(F.max(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    w = Window.partitionBy("pattern", "category").orderBy("at")
    turns = events.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0))).where("on <> was")
    spans = turns.withColumn("until", F.lead("at").over(w)).where(F.col("on") == 1)
    return spans.select("pattern", "category", F.col("at").alias("since"), "until")


def keys(host: Column, path: Column, deepest: int) -> Column:
    """Every suffix of the host, and host with every prefix of the path that has at most so many parts."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(parts), F.lit(deepest)), F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(suffixes, F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<string>"))))


def month(x: Column) -> Column:
    return (F.year(x) * 12 + F.month(x)).cast("int")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with host, n_active, categories, patterns and allowed."""
    captures, new, back = aside(captures)
    url, fetched = new.get(url, url), new.get(fetched, fetched)
    spans = cut(intervals(entries))
    # no pattern has more path parts, so longer prefixes can't match
    deepest = spans.agg(F.max(F.size(F.split("pattern", "/")))).first()[0] or 1
    bounds = captures.agg(F.min(month(F.col(fetched))).alias("a"), F.max(month(F.col(fetched))).alias("b")).first()
    low, high = (bounds.a, bounds.b) if bounds.a is not None else (0, 0)
    first, last = F.greatest(month(F.col("since")), F.lit(low)), F.least(F.coalesce(month(F.col("until")), F.lit(high)), F.lit(high))
    spread = spans.where(first <= last).withColumn("month", F.explode(F.sequence(first, last)))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), PATH, 1)
    asked = captures.select(F.col(url).alias("__url"), F.col(fetched).alias("__at"), host.alias("host"), path.alias("path")).where(F.col("__at").isNotNull()).distinct()
    dealt = asked.select("__url", "__at", month(F.col("__at")).alias("month"), F.explode(keys(F.col("host"), F.col("path"), deepest)).alias("pattern"))
    near = salted_join(dealt, cut(spread), ["pattern", "month"])
    active = near.where((F.col("since") <= F.col("__at")) & (F.col("until").isNull() | (F.col("__at") < F.col("until"))))
    listed = active.groupBy("__url", "__at").agg(F.count("*").alias("__n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("__c"), F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("__p"))
    keep = [c for c in captures.columns if c not in OUTPUTS]
    asking = captures.select(*keep, host.alias("host"), F.col(url).alias("__url"), F.col(fetched).alias("__at"))
    out = keyed_join(asking, cut(listed), ["__url", "__at"], "left")
    return out.select(*keep, "host", F.coalesce("__n", F.lit(0)).cast("long").alias("n_active"), F.coalesce("__c", F.lit("")).alias("categories"), F.coalesce("__p", F.lit("")).alias("patterns"), F.col("__n").isNull().alias("allowed")).withColumnsRenamed(back)


def _number(x: str, at: int) -> str:
    """Four hex digits of a digest as a number, in Spark's SQL."""
    return f"CAST(conv(substring(md5({x}), {at}, 4), 16, 10) AS INT)"


def dated(pages: DataFrame) -> DataFrame:
    """The page table has no fetch time: one is derived from the id."""
    return pages.select("page_id", "url", F.expr(f"date_add(DATE'2023-01-01', {_number('CAST(page_id AS STRING)', 1)} % 730)").alias("fetched"))


def derived_list(pages: DataFrame) -> DataFrame:
    """Dated list events for hosts, parent domains and first path parts that occur, chosen by digest."""
    url = F.coalesce(F.col("url"), F.lit(""))
    seen = pages.select(F.lower(F.regexp_extract(url, HOST, 1)).alias("h"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1).alias("p")).distinct().where("h <> ''")
    part = F.when(F.col("p") != "", F.concat_ws("/", "h", "p")).otherwise(F.col("h"))
    names = seen.select(F.explode(F.array(F.col("h"), F.regexp_replace("h", r"^[^.]*\.", ""), part)).alias("pattern")).distinct()
    start = f"date_add(DATE'2023-01-01', {_number('pattern', 5)} % 500)"
    length = f"({_number('pattern', 9)} % 200 + 1)"
    again = f"{_number('pattern', 13)} % 2 = 0"
    chosen = names.where(f"{_number('pattern', 1)} % 3 = 0").selectExpr(
        "pattern", f"element_at(array('ads', 'adult', 'malware', 'spam'), {_number('pattern', 17)} % 4 + 1) AS category",
        f"filter(array(struct('add' AS action, {start} AS at), struct('remove' AS action, date_add({start}, {length}) AS at), struct(if({again}, 'add', 'none') AS action, date_add({start}, {length} + 30) AS at)), x -> x.action <> 'none') AS events",
    )
    return chosen.select("pattern", "category", F.explode("events").alias("e")).select("pattern", "category", "e.action", "e.at")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return evaluate(dated(pages), cut(derived_list(pages))).withColumn("fetched", F.col("fetched").cast("string"))


OP6_SQL = r"""
WITH h AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS p,
    CAST(DATE '2023-01-01' + CAST(('0x' || md5(CAST(page_id AS VARCHAR))[1:4])::INT % 730 AS INT) AS DATE) AS fetched FROM pages
), names AS (
  SELECT DISTINCT unnest([host, regexp_replace(host, '^[^.]*\.', ''), CASE WHEN p <> '' THEN host || '/' || p ELSE host END]) AS pattern FROM h WHERE host <> ''
), l AS (
  SELECT pattern, ['ads', 'adult', 'malware', 'spam'][('0x' || md5(pattern)[17:20])::INT % 4 + 1] AS category,
    CAST(DATE '2023-01-01' + CAST(('0x' || md5(pattern)[5:8])::INT % 500 AS INT) AS DATE) AS s, ('0x' || md5(pattern)[9:12])::INT % 200 + 1 AS n,
    ('0x' || md5(pattern)[13:16])::INT % 2 = 0 AS again FROM names WHERE ('0x' || md5(pattern)[1:4])::INT % 3 = 0
), spans AS (
  SELECT pattern, category, s AS since, CAST(s + CAST(n AS INT) AS DATE) AS until FROM l
  UNION ALL SELECT pattern, category, CAST(s + CAST(n + 30 AS INT) AS DATE), DATE '9999-01-01' FROM l WHERE again
), a AS (
  SELECT page_id, url, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS c, string_agg(DISTINCT pattern, ',' ORDER BY pattern) AS p
  FROM h JOIN spans ON fetched >= since AND fetched < until AND (host = pattern OR ends_with(host, '.' || pattern)
    OR host || rtrim(path, '/') = pattern OR (contains(pattern, '/') AND starts_with(host || path, pattern || '/'))) GROUP BY page_id, url
)
SELECT h.page_id, h.url, CAST(h.fetched AS VARCHAR) AS fetched, host, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(c, '') AS categories, coalesce(a.p, '') AS patterns, n IS NULL AS allowed
FROM h LEFT JOIN a ON a.page_id = h.page_id
"""
