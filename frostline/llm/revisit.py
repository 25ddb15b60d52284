"""WARC revisit records of kind "not modified", resolved to full responses.

A crawler that is told 304 stores a revisit record without a body. Each is resolved by an as-of join: by canonical URL, to the latest
earlier full response. Its validators are checked against that response's, and the headers that a 304 may update are merged.

The as-of join is a running "last response" over each URL's records in order of time. A URL may hold a third of all records, so
the records are dealt in ranges of (URL, time): the running value is formed in each piece of a URL, and the last responses of the
pieces, a row a piece, are carried over in a second, small window. Bodies join afterwards, for resolved records alone.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from frostline.llm.common import Scratch

#: Query parameters that do not tell pages apart. Fixed values.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref|session_id)="
#: Headers that a 304 never updates: they describe the stored body or one connection. Fixed values.
KEPT = (
    "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type", "transfer-encoding",
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """A URL's key: no scheme, user, fragment, standard port, www. and tracking parameters; lower-case host, sorted parameters, no last slash."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", "")
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+", "/"), r"/$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _lower_keys(headers: Column) -> Column:
    """Headers with lower-case names; of names that clash the alphabetically last value stays."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.coalesce(e["value"], F.lit("")).alias("value"))))
    last = F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["key"] != e["key"], F.lit(True)))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, updated by those of the 304 that may be."""
    update = F.map_filter(revisit, lambda k, v: ~k.isin(*KEPT))
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.map_contains_key(update, k)), update)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve(records: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a revisit record: record_id, url_key, date, outcome, response_id, headers.

    records: record_id, kind ('response' or 'revisit'; others are ignored), url, date (timestamp), status (int), headers (map of strings). A full
    response has status 200. Earlier means a smaller date; of responses of one date the one with the largest record_id counts.

    outcome: 'resolved' (the ETags agree weakly or, where the revisit has none, the Last-Modified values do), 'mismatch' (a validator differs or the
    response has none of that kind), 'unchecked' (the revisit has no validator) or 'missing' (no earlier response). response_id stands with
    all but 'missing'; headers are merged where resolved, else the revisit's own. Revisits with a null URL or date are 'missing', such
    responses are never found. Repeated rows stay. Other columns stay out.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "date", canonical_url(F.col("url")).alias("url_key"), _lower_keys(F.col("headers")).alias("headers"), (F.col("kind") == "response").alias("full"), "status"
    )
    rows = rows.where(~F.col("full") | (F.col("status") == 200))
    lost = F.isnull("url_key") | F.isnull("date")
    rows = rows.where(~lost | ~F.col("full"))
    # a response counts for later dates only, so at one date revisits stand first
    pieces = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(pieces, "url_key", "date", "full", "record_id").withColumn("piece", F.spark_partition_id())
    dealt = scratch.stage("dealt", dealt)
    own = F.when(F.col("full"), F.struct("record_id", "headers"))
    order = Window.partitionBy("url_key", "piece").orderBy("date", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    near = dealt.withColumn("near", F.last(own, ignorenulls=True).over(order)).where("not full")
    ends = dealt.where("full").groupBy("url_key", "piece").agg(F.max_by(F.struct("record_id", "headers"), F.struct("date", "record_id")).alias("end"))
    marks = dealt.select("url_key", "piece").distinct().join(ends, ["url_key", "piece"], "left")
    before = Window.partitionBy("url_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("carried", F.last("end", ignorenulls=True).over(before)).select("url_key", "piece", "carried").where("carried is not null")
    found = near.join(marks, ["url_key", "piece"], "left").withColumn("r", F.coalesce("near", "carried"))
    etag, theirs = F.col("headers")["etag"], F.col("r.headers")["etag"]
    modified, then = F.col("headers")["last-modified"], F.col("r.headers")["last-modified"]
    agrees = F.when(etag.isNotNull(), _weak(etag) == _weak(theirs)).otherwise(modified == then)
    outcome = (
        F.when(F.isnull("r") | F.isnull("date"), "missing").when(etag.isNull() & modified.isNull(), "unchecked").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    )
    out = found.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return out.select(
        "record_id", "url_key", "date", "outcome", F.when(F.col("outcome") != "missing", F.col("r.record_id")).alias("response_id"),
        F.when(good, merged_headers(F.col("r.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def with_bodies(resolved: DataFrame, records: DataFrame, body: str = "body") -> DataFrame:
    """resolved with the response's body where the outcome is 'resolved', else null; record_ids of responses are taken to be unique."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), F.col(body).alias("body"))
    hit = resolved.where("outcome = 'resolved'").join(bodies, "response_id", "left")
    rest = resolved.where("outcome != 'resolved'").withColumn("body", F.lit(None).cast(bodies.schema["body"].dataType))
    return hit.select(*rest.columns).unionByName(rest)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Records for the pages table (page_id, url, html), which has no crawl dates: a full response of each page and a later revisit.

    Everything is arithmetic on page_id, so that SQL can state it too. Some revisits have another ETag, only a date, or no validator, and some
    name the page by another form of its URL.
    """
    i = F.col("page_id")
    second = F.lit(1_700_000_000) + (i * 7919) % 100_000
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    modified = F.concat(F.lit("day "), (i % 50).cast("string"))
    first = F.create_map(
        F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Content-Type"), F.lit("text/html"),
        F.lit("Content-Length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Cache-Control"), F.concat(F.lit("max-age="), (i % 100).cast("string")),
    )
    check = F.when(i % 11 == 5, F.create_map().cast("map<string,string>")).when(i % 7 == 3, F.create_map(F.lit("last-modified"), modified))
    check = check.when(i % 5 == 0, F.create_map(F.lit("etag"), F.lit('"other"'))).otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag)))
    again = F.map_concat(F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"), F.lit("x-cache"), F.lit("hit")), check)
    later = second + 1 + (i % 3) * 50_000
    other = F.when(i % 2 == 0, F.concat("url", F.lit("#again"))).otherwise(F.regexp_replace("url", "^http://", "https://"))
    response = F.struct((i * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url"), F.timestamp_seconds(second).alias("date"), F.lit(200).alias("status"), first.alias("headers"), F.col("html").alias("body"))
    revisit = F.struct((i * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), other.alias("url"), F.timestamp_seconds(later).alias("date"), F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("body"))
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def digests(resolved: DataFrame) -> DataFrame:
    """record_id, url_key, outcome, response_id, headers as sorted lines, body_md5 of resolved records with bodies."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolved.select("record_id", "url_key", "outcome", "response_id", lines.alias("headers"), F.md5("body").alias("body_md5"))


_KEPT_SQL = ", ".join(f"'{k}'" for k in KEPT)
ORACLE = rf"""
WITH p AS (
  SELECT page_id AS i, url, html, 1700000000 + (page_id * 7919) % 100000 AS sec,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (page_id % 50) AS modified FROM pages),
raw AS (
  SELECT i * 2 AS record_id, true AS is_full, url, sec, tag AS etag, modified AS last_modified, html,
    ['etag: ' || tag, 'last-modified: ' || modified, 'content-type: text/html', 'content-length: ' || length(coalesce(html, '')),
     'cache-control: max-age=' || (i % 100)] AS headers FROM p
  UNION ALL
  SELECT i * 2 + 1, false, CASE WHEN i % 2 = 0 THEN url || '#again' ELSE regexp_replace(url, '^http://', 'https://') END,
    sec + 1 + (i % 3) * 50000, etag, lm, NULL,
    list_filter(['cache-control: max-age=60', 'content-length: 0', 'x-cache: hit', 'etag: ' || etag, 'last-modified: ' || lm], lambda x: x IS NOT NULL)
  FROM (SELECT *, CASE WHEN i % 11 = 5 OR i % 7 = 3 THEN NULL WHEN i % 5 = 0 THEN '"other"' ELSE 'W/' || tag END AS etag,
    CASE WHEN i % 11 <> 5 AND i % 7 = 3 THEN modified END AS lm FROM p)),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS b FROM raw),
parts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '{TRACKING}'))) AS query
  FROM bare),
keyed AS (SELECT *, host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS url_key FROM parts),
met AS (
  SELECT v.*, r.record_id AS rid, r.etag AS retag, r.last_modified AS rlm, r.headers AS rheaders, r.html AS rhtml
  FROM (SELECT * FROM keyed WHERE NOT is_full) v ASOF LEFT JOIN
    (SELECT * FROM keyed WHERE is_full QUALIFY row_number() OVER (PARTITION BY url_key, sec ORDER BY record_id DESC) = 1) r
  ON v.url_key = r.url_key AND v.sec > r.sec),
judged AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'missing' WHEN etag IS NULL AND last_modified IS NULL THEN 'unchecked'
    WHEN coalesce(CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', '') ELSE last_modified = rlm END, false)
    THEN 'resolved' ELSE 'mismatch' END AS outcome,
    list_filter(headers, lambda h: split_part(h, ': ', 1) NOT IN ({_KEPT_SQL})) AS up FROM met),
named AS (SELECT *, list_transform(up, lambda h: split_part(h, ': ', 1)) AS up_names FROM judged)
SELECT record_id, url_key, outcome, rid AS response_id,
  array_to_string(list_sort(CASE WHEN outcome = 'resolved'
    THEN list_concat(list_filter(rheaders, lambda h: NOT list_contains(up_names, split_part(h, ': ', 1))), up) ELSE headers END), chr(10)) AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(rhtml) END AS body_md5
FROM named
"""
