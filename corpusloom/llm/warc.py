"""WARC revisit resolution: an as-of join of not-modified records to the latest earlier full response.

Records are keyed by canonical URL (scheme and host in lower case, without default port, user
info, fragment, session and tracking parameters; the other parameters sorted; a trailing slash
dropped). A revisit takes the latest full response of its URL that is earlier by (date,
record_id). Its validators are checked: where both sides have an etag (compared weakly) that
decides, else where both have a last-modified date, else the resolution stands unverified. The
merged headers are the stored ones, overridden by the revisit's, except headers that describe the
stored payload or the connection (``NOT_UPDATED``).

Scale: the as-of join is a distributed sorted scan. Light rows (no payload, no headers) are range
partitioned by (url, date, record_id) and written, which fixes their parts; within a part a window
carries the last full response forward, and a part's carry-in is the last full response of the
URL's earlier parts, of which one row a part and URL is kept. So one URL may hold a third of all
records and spreads over many parts. Payload and headers join by record id afterwards.

Defined results: records without URL, date or id are unresolved; only ``response`` records with
status 200 are full; equal dates go by record id; full rows that repeat an id count once (smallest
URL); a revisit without an earlier full response is 'unresolved', one with other validators
'mismatch', both without payload; empty tables give no rows; null headers are an empty map; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import stored

#: Headers of a not-modified answer that don't replace the stored ones.
NOT_UPDATED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Fixed value: parameters that don't name a page.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|phpsessid|jsessionid|sid)="


def canonical_url(url: Column) -> Column:
    x = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_replace(F.regexp_extract(x, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1), "^.*@", ""))
    host = F.when(head == "http", F.regexp_replace(host, ":80$", "")).when(head == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(x, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(x, "\\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.when(head == "", x).otherwise(F.concat(head, F.lit("://"), host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def _tag(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^W/", "")


def merged_headers(kept: Column, new: Column) -> Column:
    """The stored headers (names in lower case), updated by the permitted ones of the revisit."""
    none = F.create_map().cast("map<string,string>")
    low = lambda m: F.transform_keys(F.coalesce(m, none), lambda k, _: F.lower(k))
    a, b = low(kept), F.map_filter(low(new), lambda k, _: ~k.isin(*NOT_UPDATED))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def as_of(rows: DataFrame) -> DataFrame:
    """(record_id, full_id): of each revisit, the latest earlier full row; rows: url, date, record_id, is_full."""
    cut = stored(rows.repartitionByRange("url", "date", "record_id").withColumn("part", F.spark_partition_id()), "revisits")
    place = F.when(F.col("is_full"), F.struct("date", "record_id"))
    ends = cut.groupBy("url", "part").agg(F.max(place).alias("end"))
    earlier = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("url", "part", F.max("end").over(earlier).alias("carry"))
    within = Window.partitionBy("url", "part").orderBy("date", "record_id", F.desc("is_full")).rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.withColumn("seen", F.max(place).over(within)).where(~F.col("is_full"))
    return seen.join(carry, ["url", "part"]).select("record_id", F.coalesce("seen", "carry")["record_id"].alias("full_id"))


def resolve(records: DataFrame) -> DataFrame:
    """Each record with url_key, full_id, state, merged headers and payload.

    records: record_id, url, date, kind ('response' or 'revisit'), status int, etag,
    last_modified, headers map<string,string>, payload.
    """
    r = records.select("record_id", "url", "date", "kind", "status", "etag", "last_modified", "headers", "payload").withColumn("url_key", canonical_url(F.col("url")))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    known = F.col("url_key").isNotNull() & F.col("date").isNotNull() & F.col("record_id").isNotNull()
    light = r.where(known & (full | (F.col("kind") == "revisit"))).select(F.col("url_key").alias("url"), "date", "record_id", F.coalesce(full, F.lit(False)).alias("is_full"))
    found = as_of(light).groupBy("record_id").agg(F.max("full_id").alias("full_id")).where("full_id is not null")
    src = r.where(full & known).groupBy("record_id").agg(F.min(F.struct("url_key", "etag", "last_modified", F.map_entries("headers").alias("h"), "payload")).alias("f")).select(F.col("record_id").alias("f_id"), "f")
    none = F.lit(None).cast("map<string,string>")
    revisits = r.where(F.col("kind") == "revisit").drop("payload")  # only full responses' payloads are shuffled, once
    out = revisits.join(found.select(F.col("record_id").alias("r_id"), "full_id"), F.col("record_id") == F.col("r_id"), "left").join(src, F.col("full_id") == F.col("f_id"), "left")
    etags = F.col("etag").isNotNull() & F.col("f.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("f.last_modified").isNotNull()
    same = F.when(etags, _tag(F.col("etag")) == _tag(F.col("f.etag"))).when(dates, F.col("last_modified") == F.col("f.last_modified"))
    state = F.when(F.col("f_id").isNull(), "unresolved").when(same, "verified").when(same.isNull(), "unverified").otherwise("mismatch")
    good = state.isin("verified", "unverified")
    resolved = out.select(
        "record_id", "url_key", "kind", "full_id", state.alias("state"),
        F.when(good, merged_headers(F.map_from_entries("f.h"), F.col("headers"))).otherwise(merged_headers(F.col("headers"), none)).alias("headers"),
        F.when(good, F.col("f.payload")).alias("payload"),
    )
    own = r.where(F.col("kind").isNull() | (F.col("kind") != "revisit")).select(
        "record_id", "url_key", "kind", F.lit(None).cast(found.schema["full_id"].dataType).alias("full_id"), F.when(full, "full").otherwise("other").alias("state"), merged_headers(F.col("headers"), none).alias("headers"), "payload"
    )
    return own.union(resolved)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two records a page: its response and a later not-modified answer, with validators and headers drawn from the id.

    Of the answers, one in five has another etag and one in seven no etag, of which some have a date.
    """
    etag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("date"), F.lit("response").alias("kind"), F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status"), etag.alias("etag"),
        F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string")).alias("last_modified"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Age"), F.lit("0"), F.lit("X-Page"), F.col("page_id").cast("string")).alias("headers"), F.col("html").alias("payload"),
    )
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), (F.col("page_id") + F.col("page_id") % 97).alias("date"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(F.col("page_id") % 5 == 0, F.lit('"other"')).when(F.col("page_id") % 7 != 0, F.concat(F.lit("W/"), etag)).alias("etag"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))).alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("none"), F.lit("age"), (F.col("page_id") % 97).cast("string")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return response.union(revisit)
