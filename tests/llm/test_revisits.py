import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from commitlens.llm import revisits

SCHEMA = "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, digest string"


@pytest.mark.parametrize("url, want", [
    ("HTTP://User:pw@WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#frag", "example.com/a/b?a=1&b=2"), ("https://example.com", "example.com"),
    ("http://www2.example.com./", "example.com"), ("example.com/a?", "example.com/a"), ("http://example.com/A?sid=9&&x", "example.com/A?x"),
    (" ", None), (None, None), ("http://e.com/a//", "e.com/a"), ("http://e.com:8080/?q=a/b", "e.com:8080?q=a/b"),
])
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string").select(revisits.canonical_url(F.col("u")).alias("k"))
    assert df.first().k == want


def brute(rows):
    full = defaultdict(list)
    for r in rows:
        if r[3] == 200 and r[1] and r[2] is not None:
            full[r[1].split("#")[0].removeprefix("http://").rstrip("/")].append(r)
    out = []
    for r in rows:
        if r[3] != 304:
            continue
        before = [f for f in full.get((r[1] or "").split("#")[0].removeprefix("http://").rstrip("/"), []) if r[2] is not None and f[2] < r[2]]
        f = max(before, key=lambda f: (f[2], f[0])) if before else None
        tag = lambda e: ((e or "").removeprefix("W/") or None)
        if f is None:
            reason = "no_response"
        elif tag(r[4]):
            reason = "etag" if tag(r[4]) == tag(f[4]) else "etag_differs"
        elif r[5]:
            reason = "last_modified" if r[5] == f[5] else "date_differs"
        else:
            reason = "unchecked"
        ok = reason in ("etag", "last_modified", "unchecked")
        head = {k.lower(): v for k, v in (f[6] or {}).items()} if ok else None
        if ok:
            head.update({k.lower(): v for k, v in (r[6] or {}).items() if k.lower() not in revisits.NOT_MERGED})
        out.append((r[0], f and f[0], reason, head and tuple(sorted(head.items())), f[7] if ok else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.record_id, r.refers_to, r.reason, r.headers and tuple(sorted(r.headers.items())), r.digest) for r in df.collect()), key=str)


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_against_brute_force(spark, bucket):
    rnd = random.Random(bucket)
    rows = []
    for i in range(600):
        hot = rnd.random() < 0.4
        rows.append((i, None if rnd.random() < 0.02 else f"http://{'hot' if hot else rnd.choice('abcdefgh')}.com/{rnd.choice(['', '#x'])}", rnd.choice([None, *range(60)]) if rnd.random() < 0.1 else rnd.randrange(60),
                     rnd.choice([200, 304, 304, 404]), rnd.choice([None, "", "e1", "e2", "W/e1"]), rnd.choice([None, "d1", "d2"]),
                     rnd.choice([None, {}, {"ETag": "e1", "Content-Length": "5"}, {"Date": str(i), "X-A": "1", "Connection": "close"}]), f"g{i}"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(revisits.resolve(df, bucket)) == brute(rows)


def test_odd_tables(spark):
    rows = [(1, "http://a.com", 1, 200, "e", None, {"A": "1", "a": "2"}, "g"), (1, "http://a.com", 1, 200, "e", None, {"A": "1", "a": "2"}, "g"),
            (2, "http://a.com", 5, 304, "e", None, None, None), (2, "http://a.com", 5, 304, "e", None, None, None), (None, None, None, 304, None, None, None, None), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("reason", F.lit("x")).withColumn("url_key", F.lit("y"))
    out = revisits.resolve(df).collect()
    assert len(out) == 3
    assert [r.headers for r in out if r.record_id == 2] == [{"a": "2"}] * 2
    assert revisits.resolve(df.limit(0)).count() == 0
