"""URL filters whose lists change over time: a temporal list join.

A list is a log of dated entries: from ``listed_at`` on, a pattern (a host with all
its subdomains, or a host and path prefix) has an action, ``block`` or ``allow``, or
is taken off by ``remove``.  Per pattern the entries become validity intervals
[listed_at, next entry); a capture is judged by the intervals that hold its fetch
time.  Every capture gives its few possible patterns (the suffixes of its host, each
alone and with the prefixes of its path, as deep as the list's deepest pattern), these
meet the entries by equality, and the as-of condition picks the one interval of a
pattern.  The most specific pattern decides: the longest host, then the longest path.

Defined results
* A URL that is null or has no host matches nothing and is not blocked; a null fetch time lies in no interval.
* Host names are compared in lower case, without port, trailing dot and user (what stands before the last ``@``);
  paths as written, without empty segments.  Listed patterns are brought into the same form, with or without a scheme.
* An address (digits and dots, or in brackets) has no domains above it.
* Entries with a null pattern, time or action take no part.  Of entries at the same time
  for one pattern ``block`` wins over ``allow`` over ``remove``; repeated entries are one.
* Rows that repeat a capture each get their row.  Empty tables give an empty result, or no matches.
* Only the named columns are read, so others do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import small, staged

#: Rows of the interval table up to which it is broadcast (about 80 bytes each).
BROADCAST_ROWS = 200_000
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
ADDRESS = r"^\[|^[0-9.]+$"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null if it has none."""
    place = F.regexp_replace(F.regexp_extract(url, SCHEME + r"([^/?#]*)", 1), r"^.*@", "")
    host = F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def segments_of(url: Column) -> Column:
    """The segments of a URL's path that are not empty."""
    return F.filter(F.split(F.regexp_extract(url, SCHEME + r"[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")


def normal(pattern: Column) -> Column:
    """A listed pattern as captures give it: the host in lower case, then the path; null without a host."""
    url = F.when(pattern.rlike(SCHEME), pattern).otherwise(F.concat(F.lit("http://"), pattern))
    return F.concat(host_of(url), F.array_join(F.transform(segments_of(url), lambda p: F.concat(F.lit("/"), p)), ""))


def patterns_of(url: Column, depth: int) -> Column:
    """All patterns that a URL can match, of at most ``depth`` segments, the most specific first."""
    labels = F.when(host_of(url).rlike(ADDRESS), F.array(host_of(url))).otherwise(F.split(host_of(url), r"\."))
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = segments_of(url)
    deep = F.least(F.size(parts), F.lit(depth))
    paths = F.transform(F.when(deep > 0, F.sequence(deep, F.lit(1), F.lit(-1))).otherwise(F.expr("array()").cast("array<int>")), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    each = F.flatten(F.transform(hosts, lambda h: F.concat(F.transform(paths, lambda p: F.concat(h, p)), F.array(h))))
    return F.when(host_of(url).isNotNull(), each)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of the entries (pattern, listed_at, action) that block or allow."""
    usable = entries.select(normal(F.col("pattern")).alias("pattern"), "listed_at", "action").where("pattern is not null and listed_at is not null and action in ('block', 'allow', 'remove')")
    order = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    once = usable.groupBy("pattern", "listed_at").agg(F.min_by("action", order).alias("action"))
    line = Window.partitionBy("pattern").orderBy("listed_at")
    spans = once.withColumn("valid_to", F.lead("listed_at").over(line)).withColumnRenamed("listed_at", "valid_from")
    return spans.where("action <> 'remove'").select("pattern", "action", "valid_from", "valid_to")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, url, fetched_at, host, pattern, action, blocked) of every capture."""
    spans, fits = small(intervals(entries), BROADCAST_ROWS)
    depth = spans.agg(F.coalesce(F.max(F.size(F.split("pattern", "/"))) - 1, F.lit(0)).alias("depth")).first().depth
    listed = spans.withColumnRenamed("pattern", "p")
    rows = captures.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{time_col}`").alias("fetched_at"))
    asked = rows.select("url", "fetched_at").distinct().select("url", "fetched_at", F.posexplode(patterns_of(F.col("url"), depth)).alias("place", "p"))
    valid = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = asked.join(F.broadcast(listed) if fits else listed, "p").where(valid)
    verdicts = staged(hits.groupBy("url", "fetched_at").agg(F.min_by(F.struct("p", "action"), "place").alias("v")))
    out = rows.join(verdicts, ["url", "fetched_at"], "left")
    return out.select("id", "url", "fetched_at", host_of(F.col("url")).alias("host"), F.col("v.p").alias("pattern"), F.col("v.action").alias("action"), F.coalesce(F.col("v.action") == "block", F.lit(False)).alias("blocked"))


def blocklist(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``, by rules on each host's hash: the tables have no list of their own.

    A quarter of the hosts is blocked at some day of 2024, half of these are taken off
    later, ``/en`` is allowed on a third of all hosts, for a fifth the domain above is blocked, and the path
    of every tenth page is blocked or allowed, listed as upper-case host and whole path.
    """
    paths = pages.where((F.col("page_id") % 10 == 3) & host_of(F.col("url")).isNotNull())
    path = F.regexp_extract("url", SCHEME + r"[^/?#]*([^?#]*)", 1)
    paths = paths.select(F.concat(F.upper(host_of(F.col("url"))), path).alias("pattern"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 200).cast("int")).alias("listed_at"), F.when(F.col("page_id") % 20 == 3, "block").otherwise("allow").alias("action"))
    hosts = pages.select(host_of(F.col("url")).alias("h")).where("h is not null").distinct()
    hosts = hosts.withColumn("n", F.conv(F.substring(F.md5("h"), 1, 6), 16, 10).cast("long"))

    def day(offset: Column) -> Column:
        return F.date_add(F.lit("2024-01-01").cast("date"), offset.cast("int"))

    above = F.regexp_replace("h", r"^[^.]*\.", "")
    rules = F.array(
        F.when(F.col("n") % 4 == 0, F.struct(F.col("h").alias("pattern"), day(F.col("n") % 180).alias("listed_at"), F.lit("block").alias("action"))),
        F.when(F.col("n") % 8 == 0, F.struct(F.col("h").alias("pattern"), day(F.floor(F.col("n") / 4) % 180 + 180).alias("listed_at"), F.lit("remove").alias("action"))),
        F.when(F.col("n") % 3 == 0, F.struct(F.concat("h", F.lit("/en")).alias("pattern"), day(F.col("n") % 97).alias("listed_at"), F.lit("allow").alias("action"))),
        F.when((F.col("n") % 5 == 0) & (F.size(F.split("h", r"\.")) > 3), F.struct(above.alias("pattern"), day(F.col("n") % 300).alias("listed_at"), F.lit("block").alias("action"))),
    )
    return hosts.select(F.explode(F.array_compact(rules)).alias("e")).select("e.*").unionByName(paths)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page judged by the list as it was on the day of its fetch (day page_id mod 366 of 2024)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return judge(captures, blocklist(pages)).withColumnRenamed("id", "page_id")


OP4_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched_at,
                  nullif(rtrim(lower(regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '^(\[[^\]]*\]|[^:]*)', 1)), '.'), '') AS host,
                  '/' || array_to_string(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), '/') || '/' AS path
           FROM pages),
h AS (SELECT DISTINCT host AS h, ('0x' || substr(md5(host), 1, 6))::BIGINT AS n FROM p WHERE host IS NOT NULL),
e AS (SELECT h AS host, '' AS path, DATE '2024-01-01' + (n % 180)::INT AS listed_at, 'block' AS action FROM h WHERE n % 4 = 0
      UNION ALL SELECT h, '', DATE '2024-01-01' + ((n // 4) % 180 + 180)::INT, 'remove' FROM h WHERE n % 8 = 0
      UNION ALL SELECT h, '/en', DATE '2024-01-01' + (n % 97)::INT, 'allow' FROM h WHERE n % 3 = 0
      UNION ALL SELECT regexp_replace(h, '^[^.]*\.', ''), '', DATE '2024-01-01' + (n % 300)::INT, 'block' FROM h WHERE n % 5 = 0 AND len(string_split(h, '.')) > 3
      UNION ALL SELECT host, rtrim(path, '/'), DATE '2024-01-01' + (page_id % 200)::INT, CASE WHEN page_id % 20 = 3 THEN 'block' ELSE 'allow' END FROM p WHERE page_id % 10 = 3 AND host IS NOT NULL),
o AS (SELECT host, path, listed_at, min(CASE action WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END) AS a FROM e GROUP BY ALL),
v AS (SELECT *, lead(listed_at) OVER (PARTITION BY host, path ORDER BY listed_at) AS until FROM o),
m AS (SELECT p.page_id, v.host || v.path AS pattern, CASE v.a WHEN 0 THEN 'block' ELSE 'allow' END AS action,
             row_number() OVER (PARTITION BY p.page_id ORDER BY len(v.host) DESC, len(v.path) DESC) AS k
      FROM p JOIN v ON (p.host = v.host OR NOT regexp_matches(p.host, '^\[|^[0-9.]+$') AND ends_with(p.host, '.' || v.host)) AND (v.path = '' OR starts_with(p.path, v.path || '/'))
      WHERE v.a < 2 AND v.listed_at <= p.fetched_at AND (v.until IS NULL OR p.fetched_at < v.until))
SELECT p.page_id, p.url, p.fetched_at, p.host, m.pattern, m.action, coalesce(m.action = 'block', false) AS blocked
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""
