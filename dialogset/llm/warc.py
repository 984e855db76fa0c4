"""Operator 9: WARC not-modified revisits.

A revisit record says that a page had not changed (status 304): it has headers
but no payload. It is resolved by an as-of join: the latest earlier full
response of the same canonical URL, if the revisit's validator agrees with
it (entity tag compared weakly; the modification date only where one side has no
tag). The resolved record has the response's headers updated by the
revisit's, except those a 304 may not change (``KEPT``).

The as-of join is a two-level scan: narrow records are range-partitioned by
(URL, time), so a URL with very many captures spans partitions; inside a
partition a window carries the last response forward; across partitions only
URLs cut by a boundary (at most two per partition) need the last response of
earlier partitions, a small broadcast table. Payloads are never shuffled.

Edge cases: a null URL is never resolved (``missing``); of responses at one
time the greatest record_id counts, and a response at the revisit's own time
is earlier; without a validator on either side the record is ``unchecked``
and refers to the response; a record of null kind is no response, is returned
as ``unknown`` and refers to none; null headers are none; repeated rows are each
returned; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogset.session import pin

# fixed values: headers of the stored response that a 304 does not change
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host without www. or m. and default port, path without a trailing slash,
    in lower case up to the path; no scheme and fragment; query parameters
    other than tracking ones, in order of their text."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    split = F.split(bare, r"\?", 2)
    before = split[0]
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(before, "/", 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(before, r"^[^/]*", ""), r"/+$", "")
    params = F.filter(F.split(F.coalesce(F.get(split, F.lit(1)), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))
    query = F.array_join(F.sort_array(params), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], r"^[wW]/", "")


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers updated by the revisit's permitted ones."""
    empty = F.expr("cast(map() as map<string,string>)")
    response, revisit = F.coalesce(response, empty), F.coalesce(revisit, empty)
    new = F.map_filter(revisit, lambda k, v: ~k.isin(*KEPT))
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, ts, kind: response or
    revisit, headers: map with lower-case names): record_id, url (canonical),
    ts, refers_to, status (resolved, unchecked, mismatch, missing, unknown) and headers
    (merged if it refers to a response, else the revisit's own)."""
    narrow = records.select("record_id", canonical_url(F.col("url")).alias("url"), "ts", "kind", "headers")
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_revisit = ~F.col("kind").eqNullSafe("response")
    keys = ["url", "ts", "later", "record_id"]
    ranged = narrow.withColumn("later", is_revisit.cast("int")).repartitionByRange(n, *keys)
    ranged = pin(ranged.withColumn("block", F.spark_partition_id()), "warc-ranged")

    response = F.when(~is_revisit, F.struct("record_id", "headers"))
    edges = ranged.groupBy("block").agg(F.min("url").alias("lo"), F.max("url").alias("hi"))
    cut = F.broadcast(edges.select(F.explode(F.array("lo", "hi")).alias("url")).where("url is not null").distinct())  # two per partition
    order = F.struct("ts", "record_id")
    lasts = ranged.where(~is_revisit).join(cut, "url", "left_semi").groupBy("url", "block").agg(F.max_by(F.struct("record_id", "headers"), order).alias("last"))
    # the last response before each later block of a cut URL
    blocks = ranged.join(cut, "url", "left_semi").select("url", "block").distinct().join(lasts, ["url", "block"], "left")
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("url", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))

    inside = Window.partitionBy("block", "url").orderBy("ts", "later", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.withColumn("seen", F.last(response, ignorenulls=True).over(inside)).where(is_revisit)
    joined = seen.join(F.broadcast(carried), ["url", "block"], "left").withColumn(  # at most two rows per partition and cut URL
        "r", F.when(F.col("url").isNotNull(), F.coalesce("seen", "carried"))
    )
    mine, theirs = F.col("headers"), F.col("r.headers")
    agree = F.coalesce(_tag(mine) == _tag(theirs), mine["last-modified"] == theirs["last-modified"])
    status = F.when(F.col("kind").isNull(), "unknown").when(F.col("r").isNull(), "missing").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    out = joined.withColumn("status", status)
    refers = F.col("status").isin("resolved", "unchecked")
    return out.select(
        "record_id",
        "url",
        "ts",
        F.when(refers, F.col("r.record_id")).alias("refers_to"),
        "status",
        F.when(refers, merged_headers(theirs, mine)).otherwise(mine).alias("headers"),
    )


def with_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """``resolved`` plus the payload of the response it refers to."""
    stored = records.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), payload)
    return resolved.join(stored, "refers_to", "left")


def _headers(**values) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k.replace("_", "-")), v if isinstance(v, Column) else F.lit(v))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def captures_of(pages: DataFrame) -> DataFrame:
    """Crawl records derived from the pages: each page is fetched once in full
    and asked for again later; and with each page its host's home page is
    asked for, answered in full for every fourth page."""
    i, digest = F.col("page_id"), F.md5(F.coalesce(F.col("html"), F.lit("")))
    host = F.concat(F.lit("http://"), F.substring_index(F.regexp_replace("url", r"^[a-z]+://", ""), "/", 1), F.lit("/"))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    home = F.concat(F.lit('"h'), F.floor(i / 40).cast("string"), F.lit('"'))
    date = (i * 60).cast("string")
    full = _headers(content_type="text/html", content_length=F.length("html").cast("string"), etag=tag, last_modified=date, date=date, server="a")
    again = _headers(
        content_length="0",
        etag=F.when(i % 5 == 0, F.lit(None)).when(i % 7 == 0, F.lit('"old"')).otherwise(F.concat(F.lit("W/"), tag)),
        last_modified=F.when(i % 10 != 0, date),
        date=(i * 60 + 90).cast("string"),
        cache_control="max-age=60",
    )
    home_full = _headers(content_type="text/html", content_length="512", etag=home, date=date, server="b")
    home_again = _headers(etag=home, date=date, expires=date)
    rows = F.array(
        F.struct((i * 4).alias("record_id"), F.col("url"), (i * 60).alias("ts"), F.lit("response").alias("kind"), full.alias("headers")),
        F.struct((i * 4 + 1).alias("record_id"), F.col("url"), (i * 60 + 90).alias("ts"), F.lit("revisit").alias("kind"), again.alias("headers")),
        F.struct(
            (i * 4 + 2).alias("record_id"),
            host.alias("url"),
            (i * 60).alias("ts"),
            F.when(i % 4 == 0, "response").otherwise("revisit").alias("kind"),
            F.when(i % 4 == 0, home_full).otherwise(home_again).alias("headers"),
        ),
    )
    return pages.select(F.inline(rows))
