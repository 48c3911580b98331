"""Not-modified revisit resolution for web archives.

A revisit record (a 304 answer to a conditional request) has no payload.  It is resolved by an as-of join:
the latest full response of the same canonical URL strictly before it.  The revisit's validators must agree
with that response's; then the record takes its payload, status and headers, updated by those headers of the
304 that it may change.

The as-of join is a window inside ranges of (URL, time, ...) plus each range's carry: the last full response of
the URL in earlier ranges, from a window over one row for each range and URL.  So a URL that holds a large part of
all records is split over ranges, however close in time they are.  Payloads are never moved; records carry the digest and
the id to fetch them by.

Outcomes.  ``full``: a response.  ``resolved``.  ``mismatch``: the latest earlier response has other
validators.  ``unverified``: no validator to compare.  ``orphan``: no earlier response, or url or time null.

Defined cases.  Responses of the same URL and time: the larger record id counts as later; a revisit at the
very time of a response doesn't see it.  ETags compare weakly (RFC 9110, 8.8.3.2) and come before
Last-Modified, which must be equal.  Header names are lower-cased; of names that then clash the last stands.
Null headers are no headers; a null kind is no response.  Repeated records are resolved alike.  Very long URLs, headers and
payloads are taken whole.  An empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize

#: Headers that a 304 may update (RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't select content.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, fragment, trailing slashes and tracking parameters; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    raw_host = F.regexp_extract(bare, "^[^/?]*", 0)
    host = F.regexp_replace(F.regexp_replace(F.lower(raw_host), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "^[^?]*[?](.*)$", 1)
    wanted = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of clashing ones the last stands."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), -1)["value"])))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, updated by the permitted ones of the 304."""
    allowed = F.map_filter(fresh, lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def _weak(etag: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(etag), "^W/", ""), F.lit(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records: record_id, url, ts (seconds or timestamp), kind (response or revisit), status, etag, last_modified, headers (map), payload_digest.

    Per record: record_id, url_key, kind, outcome, source_id, status, headers and payload_digest.
    """
    micros = F.col("ts").cast("timestamp").cast("decimal(38,6)") * 1_000_000 if dict(records.dtypes)["ts"].startswith("timestamp") else F.col("ts").cast("decimal(38,6)") * 1_000_000
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), micros.cast("long").alias("_at"), F.coalesce(F.col("kind") == "response", F.lit(False)).alias("_full"), "kind", F.col("status").cast("int").alias("status"),
        F.nullif(F.trim("etag"), F.lit("")).alias("etag"), F.nullif(F.trim("last_modified"), F.lit("")).alias("last_modified"), lower_names(F.col("headers")).alias("headers"), "payload_digest",
    )
    response = F.struct(F.col("_at").alias("at"), F.col("record_id").alias("id"), "status", "etag", "last_modified", "headers", "payload_digest")
    usable = F.col("url_key").isNotNull() & F.col("_at").isNotNull()
    ranges = rows.where(usable).repartitionByRange("url_key", "_at", "_full", "record_id")
    timed = materialize(ranges.withColumn("_range", F.spark_partition_id()), "records")

    inside = Window.partitionBy("_range", "url_key").orderBy("_at", "_full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = timed.withColumn("_near", F.last(F.when(F.col("_full"), response), ignorenulls=True).over(inside))
    # The last full response of a range; null orders are passed over.
    marks = timed.groupBy("url_key", "_range").agg(F.max_by(response, F.when(F.col("_full"), F.struct("_at", "record_id"))).alias("_end"))
    earlier = Window.partitionBy("url_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.select("url_key", "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_carry")).where("_carry is not null")
    found = near.join(carry, ["url_key", "_range"], "left").withColumn("_was", F.when(~F.col("_full"), F.coalesce("_near", "_carry")))
    lost = rows.where(~usable).withColumn("_was", F.lit(None).cast(found.schema["_was"].dataType))
    found = found.select(*lost.columns).unionByName(lost)

    same_tag = _weak(F.col("etag")) == _weak(F.col("_was.etag"))
    same_date = F.col("last_modified") == F.col("_was.last_modified")
    agrees = F.coalesce(same_tag, same_date)
    outcome = F.when(F.coalesce(F.col("_full"), F.lit(False)), "full").when(F.col("_was").isNull(), "orphan").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    out = found.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return out.select(
        "record_id", "url_key", "kind", "outcome",
        F.when(ok, F.col("_was.id")).when(F.col("outcome") == "full", F.col("record_id")).alias("source_id"),
        F.when(ok, F.col("_was.status")).otherwise(F.col("status")).alias("status"),
        F.when(ok, merge_headers(F.col("_was.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(ok, F.col("_was.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def header_lines(headers: Column) -> Column:
    """Headers as ``name: value`` lines in order of name."""
    entries = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def attach_payloads(resolved: DataFrame, payloads: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """Add the payload of each record's source; the only step that moves payloads."""
    found = payloads.select(F.col(id_col).alias("_source"), F.col(payload_col).alias("payload"))
    return materialize(resolved, "resolved").join(found, F.col("source_id") == F.col("_source"), "left").drop("_source")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records made from raw pages, by rule: each page is fetched once and asked for again later.

    Page p is fetched in minute p and asked for again 500 minutes on, by another spelling of its URL.  The
    304 repeats the page's ETag weakly; where p mod 10 is 3 it has another one, at 7 only the date, at 9 none.
    """
    p, tag = F.col("page_id"), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16)
    dated = F.concat(F.lit("day "), F.expr("page_id div 1440"))
    quoted = F.concat(F.lit('"'), tag, F.lit('"'))
    fetched = pages.select(
        (p * 2).alias("record_id"), "url", (p * 60).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), quoted.alias("etag"), dated.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("ETag"), quoted, F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("payload_digest"),
    )
    turn = p % 10
    again = F.when(turn == 3, F.lit('W/"other"')).when(turn.isin(7, 9), F.lit(None)).otherwise(F.concat(F.lit("W/"), quoted))
    asked = pages.select(
        (p * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), ((p + 500) * 60).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), again.alias("etag"), F.when(turn == 9, F.lit(None)).otherwise(dated).alias("last_modified"),
        F.create_map(F.lit("Date"), ((p + 500) * 60).cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=120")).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    return fetched.unionByName(asked)
