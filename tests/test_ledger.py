"""Exactly-once ingest through the key ledger: late rows, repeats, replays, full filters, null keys."""

import datetime as dt
import os

from pyspark.sql import functions as F

from commitlens.session import scratch_path
from commitlens.sources.sinks import append_batch
from commitlens.streaming import incremental as inc
from commitlens.streaming import ledger as lg

SCHEMA = "k string, part int, at timestamp, v int"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def rows_of(spark, sink):
    return sorted(((r.k, r.part, r.v) for r in spark.read.parquet(sink).select("k", "part", "v").collect()), key=str)


def test_old_new_row_old_repeat_and_replay(spark):
    root = scratch_path(spark, "unit_ledger")
    first = spark.createDataFrame([(f"a{i}", 1, day(i), i) for i in range(100)] + [("a5", 1, day(5), 5), (None, 1, day(3), 1), (None, None, None, 2)], SCHEMA)
    second = spark.createDataFrame([("old new", 1, day(0), 7), ("a3", 1, day(3), 99), ("a99", 1, day(99), 99), ("fresh", 1, day(120), 8), (None, 1, day(4), 3)], SCHEMA)
    args = (spark, f"{root}/in", first.schema, ["k", "part"], f"{root}/out", f"{root}/ckpt")
    first.write.mode("append").parquet(f"{root}/in")
    inc.ingest_dedup(*args, event_time="at", delay="10 days")
    inc.ingest_dedup(*args, event_time="at", delay="10 days")          # nothing new
    second.write.mode("append").parquet(f"{root}/in")
    inc.ingest_dedup(*args, event_time="at", delay="10 days")
    want = [(f"a{i}", 1, i) for i in range(100)] + [("fresh", 1, 8), ("old new", 1, 7)]
    got = spark.read.parquet(f"{root}/out")
    assert sorted((r.k, r.part, r.v) for r in got.where("k is not null").collect()) == sorted(want)
    assert sorted((str(r.part), r.v) for r in got.where("k is null").collect()) == [("1", 1), ("None", 2)]
    report = sorted(tuple(r) for r in inc.ingest_report(spark, f"{root}/out").select(
        "batch_id", "n_rows", "n_repeats_in_batch", "n_repeats_earlier", "n_accepted", "n_late", "n_late_accepted").collect())
    assert report == [(0, 103, 1, 0, 102, 0, 0), (1, 5, 0, 3, 2, 3, 1)]
    assert not os.path.exists(f"{root}/ckpt/state")                     # no operator state, so none that grows with the keys

    # the second batch is replayed: its folders are replaced by the same rows
    before = rows_of(spark, f"{root}/out")
    ledger = lg.KeyLedger(spark, f"{root}/out_ledger")
    lg.ingest_batch(second, 1, ledger, ["k", "part"], f"{root}/out", lambda df: df, F.col("at"), "10 days")
    assert rows_of(spark, f"{root}/out") == before and len(before) == 104
    assert sorted(tuple(r) for r in inc.ingest_report(spark, f"{root}/out").select("batch_id", "n_accepted").collect()) == [(0, 102), (1, 2)]


def test_full_filters_only_cost_lookups(spark):
    """One block for all keys answers "perhaps" for everything; results stay exact, also after compaction."""
    root = scratch_path(spark, "unit_ledger_full")
    for n, expected in (("small", 1), ("sized", 50_000)):
        ledger = lg.KeyLedger(spark, f"{root}/{n}", expected)
        ledger.create()
        accepted = []
        for b in range(4):
            rows = spark.range(b * 3000, b * 3000 + 6000).selectExpr("id as k", "id % 7 as v")
            lg.ingest_batch(rows, b, ledger, ["k"], f"{root}/{n}_out", lambda df: df)
            accepted.append(spark.read.parquet(f"{root}/{n}_out/batch_id={b}").count())
            if b == 2:
                ledger.compact(3)
        assert accepted == [6000, 3000, 3000, 3000]
        assert spark.read.parquet(f"{root}/{n}_out").select("k").distinct().count() == 15_000
    blooms = spark.read.parquet(f"{root}/sized/blooms").where("batch_id = -1")
    hashed = spark.range(100_000, 200_000).selectExpr("id as k").select(*lg.key_hashes(["k"]))
    wrong = hashed.join(blooms, (F.pmod("h1", F.lit(ledger.blocks)) == F.col("block")) & lg._known(F.col("bits")), "left_semi").count()
    assert wrong < 0.02 * 100_000


def test_unfinished_batch_is_replaced(spark):
    """A batch that wrote its sink folder but not its keys before it broke off."""
    root = scratch_path(spark, "unit_ledger_broken")
    ledger = lg.KeyLedger(spark, f"{root}/l")
    ledger.create()
    rows = spark.range(50).selectExpr("id as k")
    append_batch(rows.limit(20), f"{root}/out", 0)
    lg.ingest_batch(rows, 0, ledger, ["k"], f"{root}/out", lambda df: df)
    lg.ingest_batch(rows.union(rows), 1, ledger, ["k"], f"{root}/out", lambda df: df)
    assert spark.read.parquet(f"{root}/out").count() == 50
