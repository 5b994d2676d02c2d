"""URL filtering by dated lists: a temporal as-of join (DataFrame functions only).

A list is a log of dated entries ``(pattern, action, effective_on)``: ``block``
and ``allow`` open a decision for a pattern, ``clear`` ends it.  Entries become
validity intervals; every capture is judged by the entries that were active when
it was fetched, never by later ones.

A pattern is a domain (``example.com`` also covers its subdomains) or a host
with the first path segment (``blog.example.com/en``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import hot_join, materialize

#: Host of an absolute URL, without user, port, path; lower case.
_HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_SEGMENT = r"^[a-z][a-z0-9+.\-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of ``url``; empty where there is none (also for null)."""
    return F.coalesce(F.regexp_extract(F.lower(url), _HOST, 1), F.lit(""))


def segment_of(url: Column) -> Column:
    """First path segment of ``url`` in lower case, or empty."""
    return F.coalesce(F.regexp_extract(F.lower(url), _SEGMENT, 1), F.lit(""))


def _patterns(host: Column, segment: Column) -> Column:
    """All patterns that can match: each domain suffix, and host/segment."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    deep = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(suffixes, deep))
    )


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, action, valid_from, valid_to)``; valid_to is exclusive, null if open.

    Entries with a null pattern, action or date are ignored.  Of several entries
    for a pattern on one date, ``clear`` yields to ``block``, which yields to
    ``allow``; repeated entries count once.
    """
    weight = F.when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1).otherwise(0)
    daily = (
        entries.select("pattern", "action", "effective_on")
        .dropna()
        .groupBy(F.lower("pattern").alias("pattern"), F.col("effective_on").alias("valid_from"))
        .agg(F.max_by("action", weight).alias("action"))
    )
    following = F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from"))
    return daily.withColumn("valid_to", following).filter(F.col("action").isin("allow", "block"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures ``(page_id, url, fetched_on)`` with the verdict of the lists.

    Adds host, verdict (``allow``, ``block`` or ``none``), matched (the deciding
    pattern or null) and listed_since.  The longest active pattern decides; a
    host/segment pattern is longer than its host.  A null or malformed URL and
    a null fetch date match nothing.  Repeated captures keep their rows; URLs of any
    length are read whole; other columns are left out.

    Each distinct (host, segment) looks up the intervals of its patterns once (a
    pattern has one interval a date at most), and the captures are joined to those,
    as of their dates.  A hot suffix, listed or not, and a hot host stay unshuffled.
    """
    seen = captures.select("page_id", "url", "fetched_on").withColumns(
        {"host": host_of(F.col("url")), "segment": segment_of(F.col("url"))}
    )
    sites = materialize(seen.groupBy("host", "segment").agg(F.count(F.lit(1)).alias("n")), "sites")
    keyed = sites.select("host", "segment", F.explode(_patterns(F.col("host"), F.col("segment"))).alias("pattern"))
    spans = validity_intervals(entries).groupBy("pattern").agg(F.collect_list(F.struct("valid_from", "valid_to", "action")).alias("spans"))
    listed = materialize(keyed.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).join(spans, "pattern", "left"), "listed")
    covers = (
        hot_join(keyed, listed, ["pattern"], "inner")
        .filter(F.col("spans").isNotNull())
        .groupBy("host", "segment")
        .agg(F.collect_list(F.struct("pattern", "spans")).alias("covers"))
    )
    joined = hot_join(seen, materialize(sites.join(covers, ["host", "segment"], "left"), "covers"), ["host", "segment"])

    def active(cover: Column) -> Column:
        """The intervals of one pattern that hold the capture's date."""
        holds = lambda x: (x["valid_from"] <= F.col("fetched_on")) & (x["valid_to"].isNull() | (F.col("fetched_on") < x["valid_to"]))
        return F.transform(
            F.filter(cover["spans"], holds),
            lambda x: F.struct(F.length(cover["pattern"]).alias("size"), cover["pattern"].alias("pattern"), x["action"].alias("action"), x["valid_from"].alias("valid_from")),
        )

    return joined.withColumn("best", F.array_max(F.flatten(F.transform("covers", active)))).select(
        "page_id",
        "url",
        "fetched_on",
        "host",
        F.coalesce(F.col("best.action"), F.lit("none")).alias("verdict"),
        F.col("best.pattern").alias("matched"),
        F.col("best.valid_from").alias("listed_since"),
    )


def keep_allowed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The judged captures that no active entry blocks."""
    return judge(captures, entries).filter(F.col("verdict") != "block")


def _nibble(value: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), at, 2), 16, 10).cast("int")


def published_list(urls: DataFrame) -> DataFrame:
    """The dated list that ``op1`` judges by, derived from the crawl's own hosts.

    No list table exists, so each distinct host, registered domain and
    host/segment gets entries from digits of its MD5: about half are listed in
    the first year, a third of those cleared or turned round later.
    """
    hosts = urls.select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment")).filter(
        F.col("host") != ""
    ).distinct()
    patterns = hosts.select(
        F.explode(
            F.array(
                F.col("host"),
                F.substring_index("host", ".", -2),
                F.concat_ws("/", "host", F.when(F.col("segment") != "", F.col("segment"))),
            )
        ).alias("pattern")
    ).distinct()
    p = F.col("pattern")
    start = F.date_add(F.lit("2024-01-01").cast("date"), _nibble(p, 3))
    first = F.struct(F.when(_nibble(p, 1) < 96, "block").otherwise("allow").alias("action"), start.alias("effective_on"))
    second = F.struct(
        F.when(_nibble(p, 5) < 128, "clear").when(_nibble(p, 1) < 96, "allow").otherwise("block").alias("action"),
        F.date_add(start, 30 + _nibble(p, 7)).alias("effective_on"),
    )
    return (
        patterns.filter(_nibble(p, 1) < 128)
        .select("pattern", F.explode(F.when(_nibble(p, 5) < 160, F.array(first, second)).otherwise(F.array(first))).alias("e"))
        .select("pattern", "e.action", "e.effective_on")
    )


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page as a capture; its fetch date is a fixed function of page_id.  See
    ``judge`` for nulls, malformed and long URLs, ties and repeated rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(500)).cast("int"))
    return judge(pages.withColumn("fetched_on", fetched), published_list(pages))


OP1_SQL = r"""
WITH seen AS (
  SELECT page_id, url, (DATE '2024-01-01' + (page_id * 37 % 500)::INTEGER) AS fetched_on,
    coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
    coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment
  FROM pages),
hosts AS (SELECT DISTINCT host, segment, string_split(host, '.') AS parts FROM seen WHERE host <> ''),
pats AS (SELECT DISTINCT unnest([host, array_to_string(parts[greatest(1, len(parts) - 1):], '.'),
           CASE WHEN segment = '' THEN host ELSE host || '/' || segment END]) AS pattern FROM hosts),
dig AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 2))::INTEGER AS d1, ('0x' || substr(md5(pattern), 3, 2))::INTEGER AS d3,
           ('0x' || substr(md5(pattern), 5, 2))::INTEGER AS d5, ('0x' || substr(md5(pattern), 7, 2))::INTEGER AS d7 FROM pats),
ent AS (SELECT pattern, CASE WHEN d1 < 96 THEN 'block' ELSE 'allow' END AS action, DATE '2024-01-01' + d3 AS valid_from FROM dig WHERE d1 < 128
        UNION ALL
        SELECT pattern, CASE WHEN d5 < 128 THEN 'clear' WHEN d1 < 96 THEN 'allow' ELSE 'block' END, DATE '2024-01-01' + d3 + 30 + d7
        FROM dig WHERE d1 < 128 AND d5 < 160),
spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM ent),
keys AS (SELECT DISTINCT host, segment, fetched_on,
           unnest(list_concat(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
                  CASE WHEN segment = '' THEN [] ELSE [host || '/' || segment] END)) AS pattern
         FROM seen WHERE host <> ''),
best AS (SELECT host, segment, fetched_on, action, k.pattern, valid_from,
           row_number() OVER (PARTITION BY host, segment, fetched_on ORDER BY length(k.pattern) DESC, k.pattern DESC) AS rn
         FROM keys k JOIN spans s ON k.pattern = s.pattern AND s.action <> 'clear' AND s.valid_from <= fetched_on
           AND (s.valid_to IS NULL OR fetched_on < s.valid_to))
SELECT page_id, url, s.fetched_on, s.host, coalesce(action, 'none') AS verdict, pattern AS matched, valid_from AS listed_since
FROM seen s LEFT JOIN best b ON b.rn = 1 AND b.host = s.host AND b.segment = s.segment AND b.fetched_on = s.fetched_on
"""
