"""Copy-on-write versions, and the running funnel with changed verdicts."""

import os

import pytest
from pyspark.sql import functions as F

from commitlens.operators.aggregates import funnel_flags
from commitlens.session import scratch_path
from commitlens.sources.versioned import VersionedTable
from commitlens.streaming import funnel as rf


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_changed_buckets_are_rewritten(spark):
    t = VersionedTable(spark, scratch_path(spark, "unit_versioned"), ["k"], 8)
    t.create(spark.range(400).selectExpr("id as k", "cast(null as string) as v", "id % 3 as w"))
    before, old = files(f"{t.path}/data"), t.read()
    changes = spark.createDataFrame([(5, "b"), (5, "a"), (9999, "x"), (6, None)], "k long, v string")
    assert t.update(changes, ["v"]) == 1
    after = files(f"{t.path}/data")
    assert {k: after[k] for k in before} == before                                    # nothing written before is touched
    touched = {r.b for r in changes.select(t.bucket().alias("b")).distinct().collect()}
    assert {b for b, v in t.folders().items() if v == 1} == touched & set(t.folders()) and len(touched) < 8
    assert rows(t.read()) == sorted([(i, "a" if i == 5 else None, i % 3) for i in range(400)], key=str)
    assert rows(old) == rows(t.read(0)) == sorted([(i, None, i % 3) for i in range(400)], key=str)   # readers keep their version
    t.update(spark.createDataFrame([(5, "z"), (7, "q")], "k long, v string"), ["v"], prefer_new=False)
    assert {r.k: r.v for r in t.read().where("v is not null").collect()} == {5: "a", 7: "q"} and t.read().count() == 400


def test_failed_write_leaves_the_old_version(spark):
    t = VersionedTable(spark, scratch_path(spark, "unit_versioned_fail"), ["k"], 4)
    t.create(spark.range(20).selectExpr("id as k", "'a' as v"))
    change = spark.createDataFrame([(3, "b")], "k long, v string")
    with pytest.raises(Exception, match="broken"):
        t.rewrite(change, lambda old, new: old.withColumn("v", F.when(F.col("k") >= 0, F.raise_error(F.lit("broken")).cast("string"))))
    assert t.current() == 0 and {r.v for r in t.read().collect()} == {"a"}
    t.update(change, ["v"])
    assert t.current() == 1 and {r.k for r in t.read().where("v = 'b'").collect()} == {3}
    empty = VersionedTable(spark, scratch_path(spark, "unit_versioned_empty"), ["k"], 4)
    assert empty.current() == -1
    empty.create(spark.range(0).selectExpr("id as k", "'a' as v"))
    assert empty.read().count() == 0 and empty.update(change, ["v"]) == 1 and empty.read().count() == 0


def test_funnel_follows_changed_verdicts(spark):
    """Three deliveries with raised, lowered and repeated verdicts equal the funnel of the final table."""
    root = scratch_path(spark, "unit_funnel")
    schema = "k string, f int, n int, good boolean, yes boolean"
    one = [(f"c{i % 20}", i, 1, i % 4 > 0, i % 3 == 0) for i in range(100)] + [(None, 1, 1, True, True)]
    two = [(f"c{i % 20}", i, 2, i % 4 > 0, False) for i in range(0, 60, 3)] + [("new", 1, 2, True, True), ("new", 2, 2, None, None)]
    three = [(f"c{i % 20}", i, 3, True, True) for i in range(10)] + [("c3", 3, 1, False, False)] + [(None, 1, 3, False, False)]
    stages = [("all", F.lit(True)), ("good", F.col("good")), ("yes", F.col("good") & F.col("yes"))]
    cap = ("few", "yes", 1)
    final = {}
    for part in (one, two, three):
        for r in part:
            if (r[0], r[1]) not in final or final[r[0], r[1]][2] < r[2]:
                final[r[0], r[1]] = r
        df = spark.createDataFrame(part, schema)
        df.write.mode("append").parquet(f"{root}/in")
        rf.running_funnel(spark, f"{root}/in", df.schema, "k", ["f"], "n", stages, f"{root}/out", f"{root}/ckpt", cap=cap, buckets=4)
        want = funnel_flags(spark.createDataFrame(list(final.values()), schema), "k", stages, cap=cap)
        got = {r.stage: (r.n_rows, r.n_commits) for r in rf.current_funnel(spark, f"{root}/out").collect()}
        assert got == {r.stage: (r.n_rows, r.n_commits) for r in want.collect()}
    changes = spark.read.parquet(f"{root}/out")
    assert changes.where("batch_id = 1 and stage = 'yes'").first().d_rows < 0          # lowered verdicts are taken back


def test_funnel_state_is_shuffled_once(spark):
    """The grouping and the write of the state share one exchange, and the changes take one for both states; parts stay in their buckets."""
    t = VersionedTable(spark, scratch_path(spark, "unit_funnel_dealt"), ["k"], 4)
    state = [("a", 1, 0, 3), ("a", 2, 0, 1), ("b", 1, 0, 3), (None, 1, 0, 1), (None, 2, 0, 3)]
    old = spark.createDataFrame(state, "k string, f int, _order int, _flags long")
    t.create(old)
    rows_ = spark.createDataFrame([("a", 1, 1, 0), ("b", 1, -1, 0), (None, 2, 1, 1), ("c", 1, 1, 3), ("c", 1, 1, 2)], old.schema)
    last = rf.last_verdicts(t, t.read(), rows_, "k", ["f"])
    exchanges = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in x]
    assert len(exchanges(last)) == 1
    assert t.rewrite(rows_, lambda o, r: rf.last_verdicts(t, o, r, "k", ["f"]), dealt=True) == 1
    assert t.schema(1) == t.schema(0)
    want = [("a", 1, 1, 0), ("a", 2, 0, 1), ("b", 1, 0, 3), (None, 1, 0, 1), (None, 2, 1, 1), ("c", 1, 1, 3)]
    assert rows(t.read()) == sorted(want, key=str)
    for b, v in t.folders().items():
        assert all(r.b == b for r in t.read(v, [b]).select(t.bucket().alias("b")).collect())
    names, cap = ["all", "yes"], ("few", "yes", 1)
    change = rf.funnel_changes(t.read(0), t.read(1), "k", names, cap)
    assert len([x for x in exchanges(change) if "stage_order" not in x]) == 1
    # a loses its only yes but keeps a row of stage all; the null commit loses its yes; c is new
    assert {r.stage: (r.d_rows, r.d_commits) for r in change.collect()} == {"all": (0, 1), "yes": (-1, -1), "few": (-1, -1)}
