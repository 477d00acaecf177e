"""Resolution of WARC revisit records (server not modified).

A revisit is matched to the latest full response before it under the same
canonical URL, its validators are compared, and the headers that a 304 may
renew are laid over those of the response.

The as-of join is a running last value, made to survive a URL that holds a
third of all records: rows are range-partitioned by (URL, time, record), so a
hot URL is split by time; each piece finds its own last response, and what a
piece needs from those before it is carried in a table with at most two rows
per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .url_reputation import lower_ascii

#: Header names that a not-modified answer may renew.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[a-z]*|gclid|fbclid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path ("/" if empty), then what
    is left of the query without tracking parameters, sorted. Scheme and
    fragment don't count. Null without "://"."""
    part = lambda k: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)", k)
    host = F.regexp_replace(lower_ascii(part(1)), r":(80|443)?$", "")
    path = F.when(part(2) == "", "/").otherwise(part(2))
    query = F.array_join(
        F.array_sort(F.filter(F.split(part(3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&"
    )
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _same(a: Column, b: Column) -> Column:
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    return weak(a) == weak(b)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per revisit: record_id, url_key, ts, refers_to, status and headers.

    records: record_id long, ts timestamp or number, url string, kind
    ("response" or "revisit"; others are ignored), etag string, last_modified
    (same type in all rows), headers map<string,string> with lower-case names.
    Other columns aren't read. "Earlier" is by (ts, record_id).

    status: "resolved" if the entity tags agree (weak comparison), or, where one
    lacks a tag, the modification times do; "unverified" if there is no pair to
    compare; "mismatch" if the pair differs; "orphan" without an earlier
    response (refers_to null). headers: the response's with those of RENEWED
    that the revisit has, for resolved and unverified; else the revisit's own.
    Revisits with a null or unusable url, or a null ts, are orphans; responses
    with such are never referred to. Null headers read as none. Rows that repeat
    a record_id are kept, each resolved alike. An empty table gives an empty
    table.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = records.where("kind in ('response', 'revisit')").select(
        "record_id", "ts", canonical_url(F.col("url")).alias("url_key"), (F.col("kind") == "response").alias("full"), "etag",
        "last_modified", F.coalesce("headers", none).alias("headers"),
    )
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    ranged = materialize(
        rows.where(usable).repartitionByRange("url_key", "ts", "record_id").withColumn("piece", F.spark_partition_id()), "captures"
    )
    answer = F.when(
        F.col("full"),
        F.struct(F.col("record_id").alias("refers_to"), F.col("etag").alias("r_etag"), F.col("last_modified").alias("r_modified"), F.col("headers").alias("r_headers")),
    )
    before = Window.partitionBy("url_key", "piece").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("answer", F.last(answer, ignorenulls=True).over(before)).where("not full")
    pieces = ranged.groupBy("url_key", "piece").agg(
        F.max_by(answer, F.when(F.col("full"), F.struct("ts", "record_id"))).alias("final")
    )
    # only URLs that lie across a border are in more than one piece: two rows a partition at most
    pieces = pieces.withColumn("pieces", F.count("*").over(Window.partitionBy("url_key"))).where("pieces > 1")
    earlier = Window.partitionBy("url_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.select("url_key", "piece", F.last("final", ignorenulls=True).over(earlier).alias("carried"))
    found = local.join(F.broadcast(carry), ["url_key", "piece"], "left").withColumn("answer", F.coalesce("answer", "carried"))
    found = found.select("record_id", "url_key", "ts", "etag", "last_modified", "headers", "answer.*")
    tags = F.col("etag").isNotNull() & F.col("r_etag").isNotNull()
    times = F.col("last_modified").isNotNull() & F.col("r_modified").isNotNull()
    agree = F.when(tags, _same(F.col("etag"), F.col("r_etag"))).when(times, F.col("last_modified") == F.col("r_modified"))
    status = (
        F.when(F.col("refers_to").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    )
    renewed = F.map_filter("headers", lambda k, v: k.isin(*RENEWED))
    kept = F.map_filter("r_headers", lambda k, v: ~F.map_contains_key(renewed, k))
    merged = F.when(status.isin("resolved", "unverified"), F.map_concat(kept, renewed)).otherwise(F.col("headers"))
    done = found.select("record_id", "url_key", "ts", "refers_to", status.alias("status"), merged.alias("headers"))
    lost = rows.where(~usable & ~F.col("full")).select(
        "record_id", "url_key", "ts", F.lit(None).cast(ranged.schema["record_id"].dataType).alias("refers_to"),
        F.lit("orphan").alias("status"), "headers",
    )
    return done.unionByName(lost)
