"""Not-modified revisits of web archives, resolved to the response they confirm.

A revisit record (profile server-not-modified) has no body: the server answered
304.  It is resolved to the latest *earlier* full response of the same canonical
URL, if a validator agrees: the entity tags (compared weakly), or without a tag
in the revisit the times of last modification.  The answer's headers are the
response's, with those replaced or added that a 304 may update: Cache-Control,
Content-Location, Date, ETag, Expires, Last-Modified and Vary.

The as-of join never sorts a URL's records in one task.  Responses are reduced
to the last one of each (URL, hour, instant) before they move.  Two windows then
find what came before: over the hours of a URL, at most 8,784 a year however
many its records, and over the instants of an (URL, hour), at most 3,600 at the
format's resolution of a second.  Revisits look up their (URL, instant) by an
ordinary join, which adaptive execution can split where one is hot.

Defined results, by ``status``: ``resolved``; ``changed`` (the validators
differ); ``unverifiable`` (the revisit has no validator, or the response lacks
the one it has); ``no_response`` (no earlier one, or a null URL or time). Of
responses at one instant the one with the greatest record id counts; repeated
rows each get a result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Header fields of a 304 answer that update a stored response (fixed by the HTTP caching rules).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
_HOUR = 3_600_000_000


def canonical_url(url: Column) -> Column:
    """Without scheme, user, leading www., default port and fragment; host in lower case; no slash at the end of a path."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return F.concat(host, F.regexp_replace(rest, r"/+(\?|$)", "$1"))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """A row per revisit of (record_id, type, url, ts, headers map<string,string> with names in lower case).

    Gives record_id, url_key, ts, status, response_id, headers (null unless resolved)."""
    keyed = records.select("record_id", "type", canonical_url(F.col("url")).alias("url_key"), "ts", F.unix_micros("ts").alias("_at"), "headers")
    keyed = keyed.withColumn("_hour", F.floor(F.col("_at") / _HOUR))
    full = keyed.where((F.col("type") == "response") & F.col("url_key").isNotNull() & F.col("_at").isNotNull())
    value = F.struct("record_id", F.map_entries("headers").alias("headers"))
    last = lambda at: F.max_by(value, F.struct(at, F.col("record_id"))).alias("r")
    revisits = keyed.where(F.col("type") == "revisit")
    asked = revisits.where(F.col("url_key").isNotNull() & F.col("_at").isNotNull()).select("url_key", "_hour", "_at")

    # hours: the last response of every hour before
    by_hour = full.groupBy("url_key", "_hour").agg(last(F.col("_at")))
    hours = by_hour.unionByName(asked.select("url_key", "_hour").distinct(), allowMissingColumns=True).groupBy("url_key", "_hour").agg(F.max("r").alias("r"))
    before = Window.partitionBy("url_key").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("url_key", "_hour", F.last("r", ignorenulls=True).over(before).alias("_older"))

    # instants of an hour
    by_instant = full.groupBy("url_key", "_hour", "_at").agg(last(F.col("_at")))
    instants = by_instant.unionByName(asked.distinct(), allowMissingColumns=True).groupBy("url_key", "_hour", "_at").agg(F.max("r").alias("r"), F.max(F.lit(1)).alias("_n"))
    within = Window.partitionBy("url_key", "_hour").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    instants = instants.select("url_key", "_hour", "_at", F.last("r", ignorenulls=True).over(within).alias("_newer"))
    found = instants.join(hours, ["url_key", "_hour"], "left").select("url_key", "_at", F.coalesce("_newer", "_older").alias("_r"))

    out = revisits.join(found, ["url_key", "_at"], "left")
    stored = F.map_from_entries(F.col("_r")["headers"])
    tag, stored_tag = _tag(F.col("headers")["etag"]), _tag(stored["etag"])
    time, stored_time = F.col("headers")["last-modified"], stored["last-modified"]
    mine, theirs = F.when(tag.isNotNull(), tag).otherwise(time), F.when(tag.isNotNull(), stored_tag).otherwise(stored_time)
    status = (
        F.when(F.col("_r").isNull(), "no_response")
        .when(mine.isNull() | theirs.isNull(), "unverifiable")
        .when(mine == theirs, "resolved")
        .otherwise("changed")
    )
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    return out.select(
        "record_id",
        "url_key",
        "ts",
        status.alias("status"),
        F.col("_r")["record_id"].alias("response_id"),
        F.when(status == "resolved", F.map_concat(kept, update)).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Three capture records for every page, from its id, URL and content: a full response, an early revisit, a late one.

    The pages have no capture records of their own. Responses are spread over a year; every fourth late revisit has a weak
    tag, a tag of other content, only a time of last modification, or no validator."""
    p, digest = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    start = F.lit(1704067200)
    at = lambda n: F.timestamp_seconds(start + F.pmod(p * 7919, F.lit(31_000_000)) + n)
    day = F.concat(F.lit("day "), F.pmod(p, F.lit(28)).cast("string"))
    cell = F.pmod(p, F.lit(4))
    quoted = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    first = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), quoted(digest), F.lit("last-modified"), day, F.lit("date"), F.lit("first"), F.lit("server"), F.lit("a"))
    again = F.create_map(
        F.lit("date"),
        F.lit("again"),
        F.lit("cache-control"),
        F.lit("max-age=60"),
        F.lit("server"),
        F.lit("b"),
        F.lit("etag"),
        F.when(cell == 0, F.concat(F.lit("W/"), quoted(digest))).when(cell == 1, quoted(F.md5(digest))),
        F.lit("last-modified"),
        F.when(cell == 2, day),
    )
    record = lambda n, kind, seconds, headers: F.struct((p * 3 + n).alias("record_id"), F.lit(kind).alias("type"), F.col("url"), at(seconds).alias("ts"), headers.alias("headers"))
    made = F.array(record(0, "response", 0, first), record(1, "revisit", -40, again), record(2, "revisit", 86_400, again))
    return pages.select(F.inline(made))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    joined = F.array_join(F.transform(F.sort_array(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "url_key", F.unix_seconds("ts").alias("captured_at"), "status", "response_id", joined.alias("headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS d, 1704067200 + page_id * 7919 % 31000000 AS t, 'day ' || page_id % 28 AS day,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS bare FROM pages
), u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1), '/+(\?|$)', '\1') AS url_key FROM p
), resp AS (SELECT page_id * 3 AS rid, url_key AS k, t AS rt, d, day FROM u),
rev AS (
  SELECT page_id * 3 + n AS record_id, url_key, t + s AS captured_at, CASE page_id % 4 WHEN 0 THEN d WHEN 1 THEN md5(d) END AS tag, CASE WHEN page_id % 4 = 2 THEN day END AS lm,
    page_id % 4 = 0 AS weak
  FROM u, (VALUES (1, -40), (2, 86400)) AS x(n, s)
), j AS (
  SELECT rev.*, rid, d, day FROM rev LEFT JOIN LATERAL (SELECT rid, d, day FROM resp WHERE k = url_key AND rt < captured_at ORDER BY rt DESC, rid DESC LIMIT 1) ON true
), s AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN tag IS NULL AND lm IS NULL THEN 'unverifiable'
    WHEN CASE WHEN tag IS NOT NULL THEN tag = d ELSE lm = day END THEN 'resolved' ELSE 'changed' END AS status FROM j
)
SELECT record_id, url_key, captured_at, status, rid AS response_id,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: again' || chr(10) || 'etag: '
    || CASE WHEN weak THEN 'W/' ELSE '' END || '"' || d || '"' || chr(10) || 'last-modified: ' || day || chr(10) || 'server: a' END AS headers
FROM s
"""
