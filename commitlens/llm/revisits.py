"""Operator 2 - resolution of not-modified revisit records of a web archive.

Each revisit is matched as of its time to the latest earlier full response with the
same canonical URL; the validators are checked, and the headers that a 304 may update are
merged into those of the response.

The as-of join has two levels over distinct times, so no task holds all captures of a hot URL: the
last response of every (URL, time bucket) comes from an aggregate and is carried over
buckets, and inside a bucket a window over its times finds earlier responses.  Only keys, times and
record ids take part; validators, headers and digests join by record id afterwards, and
the revisits by URL and time (hot ones are split by adaptive execution).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import ascii_lower, skew_join

# fixed values: query parameters that do not select content
TRACKING = "utm_[^=]*|gclid|fbclid|msclkid|jsessionid|phpsessid|sid"
# fixed values: headers that a 304 must not change in the stored response, and hop-by-hop headers
NOT_MERGED = ("content-length", "content-encoding", "content-type", "content-range", "connection", "keep-alive", "proxy-authenticate",
              "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
BUCKET = 86_400   # seconds (or units of ``ts``) per time bucket


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, ``www``, default port and end dot; path without end slash; query without
    tracking parameters, sorted; no scheme, no fragment.  Null and blank give null."""
    rest = F.regexp_replace(F.regexp_replace(F.btrim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^[^@]*@", ""), r"\.?(:80|:443)?$", "")
    host = F.regexp_replace(ascii_lower(host), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    args = F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&", -1)
    args = F.filter(args, lambda a: (a != "") & ~F.regexp_like(a, F.lit(f"^(?i:{TRACKING})(=.*)?$")))
    query = F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(args), "&"))).otherwise("")
    return F.when(F.btrim(url) != "", F.concat(host, path, query))


def lower_headers(headers: Column) -> Column:
    """Header map with names in lower case; of names that then agree the one with the greatest value counts."""
    pairs = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                        lambda e: F.struct(ascii_lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.map_from_entries(F.transform(F.array([pairs]), lambda p: F.filter(
        p, lambda e, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda x: x["key"] == e["key"])))[0])


def merged_headers(stored: Column, update: Column) -> Column:
    """The response's headers with those of the revisit that may replace them."""
    update = F.map_filter(lower_headers(update), lambda k, _: ~k.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(lower_headers(stored), lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)


def opaque(etag: Column) -> Column:
    """Entity tag for weak comparison."""
    return F.nullif(F.regexp_replace(F.btrim(etag), r"^W/", ""), F.lit(""))


def latest_earlier(rows: DataFrame, bucket: int) -> DataFrame:
    """Rows (_x_u, _x_ts, _x_id, _x_full) -> (_x_u, _x_ts, _x_ref) for the times of revisits: id of the last full record strictly before."""
    times = (rows.withColumn("_x_b", F.floor(F.col("_x_ts") / bucket)).groupBy("_x_u", "_x_b", "_x_ts")
             .agg(F.max(F.when(F.col("_x_full"), F.col("_x_id"))).alias("_x_id"), F.max(~F.col("_x_full")).alias("_x_asked")))
    times = times.withColumn("_x_at", F.when(F.col("_x_id").isNotNull(), F.struct("_x_ts", "_x_id")))
    last = times.groupBy("_x_u", "_x_b").agg(F.max("_x_at").alias("_x_last"))
    upto = lambda *cols: Window.partitionBy("_x_u", *cols[:-1]).orderBy(cols[-1]).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_x_prev", F.max("_x_last").over(upto("_x_b"))).select("_x_u", "_x_b", "_x_prev")
    near = times.withColumn("_x_in", F.max("_x_at").over(upto("_x_b", "_x_ts"))).where("_x_asked")
    far = skew_join(near, carried, ["_x_u", "_x_b"])
    return far.select("_x_u", "_x_ts", F.coalesce("_x_in", "_x_prev")["_x_id"].alias("_x_ref")).where(F.col("_x_ref").isNotNull())


def resolve(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per revisit record.

    ``records``: record_id long, url, ts long, status int, etag, last_modified, headers map<string,string>,
    digest.  Status 200 is a full response, 304 a revisit; others are ignored.
    Result: record_id, url_key, refers_to, resolved, reason, headers, digest.  ``reason`` is ``etag``,
    ``last_modified`` or ``unchecked`` (the revisit has no validator) if resolved, else ``no_response``,
    ``etag_differs`` or ``date_differs``; then headers and digest are null and refers_to
    names the response that did not fit.

    Defined results: "earlier" is strictly earlier in ``ts``, of equal times the largest id; a revisit with a
    null or blank URL or a null time has ``no_response``; responses like that are never found; records that
    repeat an id: revisits repeat, of responses one is taken (the smallest by its JSON); extra columns are ignored.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "status", "etag", "last_modified", "headers", "digest")
    timed = r.where(F.col("url_key").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(200, 304))
    found = latest_earlier(timed.select(F.col("url_key").alias("_x_u"), F.col("ts").cast("long").alias("_x_ts"), F.col("record_id").alias("_x_id"),
                                        (F.col("status") == 200).alias("_x_full")), bucket)
    stored = (timed.where(F.col("status") == 200).withColumn("_x_s", F.struct("etag", "last_modified", "headers", "digest"))
              .groupBy("record_id").agg(F.min_by("_x_s", F.to_json("_x_s")).alias("_x_s"))
              .withColumnRenamed("record_id", "_x_ref"))
    hit = skew_join(found, stored, ["_x_ref"])
    rev = r.where(F.col("status") == 304).withColumns({"_x_u": F.col("url_key"), "_x_ts": F.col("ts").cast("long")})
    both = skew_join(rev, hit, ["_x_u", "_x_ts"], "left")
    tag, date = opaque(F.col("etag")), F.nullif(F.btrim("last_modified"), F.lit(""))
    reason = (F.when(F.col("_x_ref").isNull(), "no_response")
              .when(tag.isNotNull(), F.when(tag.eqNullSafe(opaque(F.col("_x_s.etag"))), "etag").otherwise("etag_differs"))
              .when(date.isNotNull(), F.when(date.eqNullSafe(F.btrim("_x_s.last_modified")), "last_modified").otherwise("date_differs"))
              .otherwise("unchecked"))
    out = both.withColumn("reason", reason).withColumn("resolved", F.col("reason").isin("etag", "last_modified", "unchecked"))
    return out.select("record_id", "url_key", F.col("_x_ref").alias("refers_to"), "resolved", "reason",
                      F.when(F.col("resolved"), merged_headers(F.col("_x_s.headers"), F.col("headers"))).alias("headers"),
                      F.when(F.col("resolved"), F.col("_x_s.digest")).alias("digest"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records derived from a table of pages (page_id, url, html): a full response and a later revisit each.

    The page id gives the time.  The revisit spells the URL another way and, by page id, repeats the
    entity tag, weakens it, has the date only, has a stale tag, or no validator.  Other pages with the same canonical
    URL may come between the two.
    """
    n, p = F.col("page_id"), F.pmod(F.col("page_id"), F.lit(5))
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag, date = F.concat(F.lit('"'), F.left(digest, F.lit(16)), F.lit('"')), F.concat(F.lit("t"), n.cast("string"))
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    full = F.struct((2 * n).alias("record_id"), F.col("url").alias("url"), (60 * n).alias("ts"), F.lit(200).alias("status"), tag.alias("etag"),
                    date.alias("last_modified"), pair("ETag", tag, "Content-Type", "text/html", "Content-Length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
                                                      "Date", F.concat(F.lit("d"), n.cast("string"))).alias("headers"), digest.alias("digest"))
    spelled = F.concat(F.regexp_replace("url", r"#.*$", ""), F.when(F.regexp_like("url", F.lit(r"\?[^#]*$|\?.*#")), "&").otherwise("?"), F.lit("utm_source=revisit#again"))
    later = F.struct((2 * n + 1).alias("record_id"), spelled.alias("url"), (60 * n + 30 + F.pmod(n, F.lit(7)) * 60 * 500).alias("ts"), F.lit(304).alias("status"),
                     F.when(p == 0, tag).when(p == 1, F.concat(F.lit("W/"), tag)).when(p == 3, '"stale"').alias("etag"), F.when(p == 2, date).alias("last_modified"),
                     pair("etag", F.coalesce(F.when(p == 1, F.concat(F.lit("W/"), tag)), tag), "Content-Length", "0", "DATE", F.concat(F.lit("r"), n.cast("string"))).alias("headers"),
                     F.lit(None).cast("string").alias("digest"))
    return pages.select(F.inline(F.array(full, later)))
