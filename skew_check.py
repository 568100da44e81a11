"""Skew check: one project holds a third of all commit rows.

Builds a skewed variant of the commits adapter (every third order is re-keyed to
one hot project), runs the skew-sensitive operators and, for comparison, the
naive whole-key window, with Spark's event log written to a fresh scratch
folder.  For every job it reports the largest task's run time and records read
next to the median task.  Writes docs/SKEW.md.

    python skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import io
import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def read_events(log_dir: str) -> list[dict]:
    import zstandard

    out = []
    for f in glob.glob(os.path.join(log_dir, "*", "events_*")) + glob.glob(os.path.join(log_dir, "*")):
        if os.path.isdir(f):
            continue
        raw = open(f, "rb")
        stream = zstandard.ZstdDecompressor().stream_reader(raw) if f.endswith(".zstd") else raw
        for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace"):
            try:
                out.append(json.loads(line))
            except ValueError:
                pass
    return out


def main() -> None:
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from commitlens.operators import filters
    from commitlens.operators.asof import asof_join
    from commitlens.operators import joins
    from commitlens.operators.dedup import first_per_key
    from commitlens.operators.sampling import stratified_sample
    from commitlens.plans import adapters as ad
    from commitlens.session import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="run-skew-", dir="/tmp")
    # AQE thresholds are scaled down with the data (a 256 MiB advisory size at
    # 100 TB is ~100 KiB here),
    # so partition sizes relative to the data, and therefore skew handling,
    # behave as they would on the cluster.
    spark = get_session("local[8]", 64, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": os.environ.get("SKEW_COALESCE", "false")})
    c = ad.commits(spark, sf_dir)
    order_key = F.element_at(F.split("commit_link", "/"), -1).cast("long")
    hot = F.when(order_key % 3 == 0, F.lit("https://github.com/hot/project")).otherwise(F.col("git_link"))
    orders = ad.table(spark, sf_dir, "orders")
    # materialise the skewed inputs once, so each case's stages are its own
    c.withColumn("git_link", hot).write.parquet(f"{log_dir}/data/commits")
    (orders.filter(F.col("o_orderstatus") == "F")
     .select(F.when(F.col("o_orderkey") % 3 == 0, F.lit("https://github.com/hot/project"))
             .otherwise(ad._project(F.col("o_custkey"))).alias("git_link"),
             F.col("o_orderkey").alias("rk"), F.col("o_orderdate").cast("date").alias("rd"))
     .write.parquet(f"{log_dir}/data/releases"))
    skewed = spark.read.parquet(f"{log_dir}/data/commits").repartition(16)
    rel = spark.read.parquet(f"{log_dir}/data/releases")
    share = skewed.agg(F.avg((F.col("git_link") == "https://github.com/hot/project").cast("double"))).first()[0]

    ev = ad.table(spark, sf_dir, "events")
    hot_user = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    ev.select(hot_user.alias("user_id"), "event_id", "event_type", "ts").write.parquet(f"{log_dir}/data/events")
    events = spark.read.parquet(f"{log_dir}/data/events").repartition(16)
    purchases = events.filter(F.col("event_type") != "signup").select("user_id", "event_id", "ts")
    signups = events.filter(F.col("event_type") == "signup").select(
        "user_id", F.col("event_id").alias("sid"), F.col("ts").alias("sts"))

    hot_time = F.when(F.col("event_id") % 3 == 0, F.lit("2024-06-01 00:00:00").cast(events.schema["ts"].dataType)).otherwise(F.col("ts"))
    one_time = purchases.withColumn("ts", hot_time).withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))

    cases = {
        "asof_join (date)": lambda: asof_join(skewed.select("git_link", "commit_link", "commit_date"), rel,
                                              ["git_link"], "commit_date", "rd", tie_break=["rk"], how="left"),
        "first_per_key by project": lambda: first_per_key(skewed, ["git_link"], ["commit_link", "commit_diff_file"]),
        "fanout_cap by project": lambda: filters.fanout_cap(skewed, "git_link", 10 ** 9),
        "stratified_sample, stratum = project": lambda: stratified_sample(
            skewed.select("commit_link", "git_link"), "commit_link", "git_link"),
        "NAIVE fan-out cap as a window count over project": lambda: skewed.withColumn(
            "n", F.count(F.lit(1)).over(Window.partitionBy("git_link"))).filter(F.col("n") <= 10 ** 9),
        "asof_join (timestamp, hot user)": lambda: asof_join(
            purchases, signups, ["user_id"], "ts", "sts", tie_break=["sid"], how="left"),
        "asof_join (timestamp, a third of all rows on one time)": lambda: asof_join(
            one_time, signups, ["user_id"], "ts", "sts", tie_break=["sid"], how="left"),
        "semi": lambda: joins.semi(skewed, rel, ["git_link"]),
        "anti (hot project survives)": lambda: joins.anti(skewed, rel.filter(~F.col("git_link").contains("/hot/")), on=["git_link"]),
        "match_project": lambda: joins.match_project(
            skewed.withColumn("commit_link", F.concat("git_link", F.lit("/commit/"), F.element_at(F.split("commit_link", "/"), -1))), rel),
        "propagate": lambda: joins.propagate(skewed, rel.select("git_link", "rd"), ["git_link"], ["rd"], how="left"),
        "fill_from": lambda: joins.fill_from(skewed.withColumn("rd", F.lit(None).cast("date")), rel, ["git_link"], "rd"),
    }
    walls = {}
    groups = {}
    for name, build in cases.items():
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        walls[name] = time.perf_counter() - t0
        groups[name] = name
    spark.stop()

    events = read_events(log_dir)
    job_group, stage_job = {}, {}
    for ev in events:
        if ev.get("Event") == "SparkListenerJobStart":
            g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
            job_group[ev["Job ID"]] = g
            for sid in ev.get("Stage IDs", []):
                stage_job[sid] = ev["Job ID"]
    tasks: dict[str, list[tuple[int, int]]] = {}
    for ev in events:
        if ev.get("Event") != "SparkListenerTaskEnd":
            continue
        g = job_group.get(stage_job.get(ev["Stage ID"]))
        if g is None:
            continue
        info, metrics = ev["Task Info"], ev.get("Task Metrics") or {}
        dur = info["Finish Time"] - info["Launch Time"]
        recs = (metrics.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
        tasks.setdefault(g, []).append((dur, recs, ev["Stage ID"]))

    lines = ["# Skew check", "",
             f"`python skew_check.py {sf_dir}`: one project holds {share:.1%} of the commit rows "
             "(and a third of the releases); for the timestamp as-of, one user holds a third of the events.", "",
             "AQE thresholds are scaled down with the data (advisory partition 100 KiB, skew threshold 200 KiB, "
             "broadcast off, partition coalescing off so that each task's share "
             "reflects the partitioning), so partitions relate to the data as on a cluster.  Per case, the stage whose largest "
             "task reads the most shuffled records: its tasks, records, the largest task's records and share, and "
             "task run times.  A whole-key operator puts the hot key's rows into one task.", "",
             "| case | wall s | worst stage: tasks | records read | max records / task | max task share | "
             "max task ms | median task ms |",
             "|---|---|---|---|---|---|---|---|"]
    for name in cases:
        by_stage: dict[int, list[tuple[int, int]]] = {}
        for dur, recs, sid in tasks.get(name, []):
            if recs > 0:
                by_stage.setdefault(sid, []).append((dur, recs))
        if not by_stage:
            continue
        # the stage whose largest task reads the most shuffled records
        sid = max(by_stage, key=lambda k: max(r for _, r in by_stage[k]))
        recs = [r for _, r in by_stage[sid]]
        durs = [d for d, _ in by_stage[sid]]
        lines.append(f"| {name} | {walls[name]:.2f} | {len(recs)} | {sum(recs)} | {max(recs)} | "
                     f"{max(recs) / sum(recs):.1%} | {max(durs)} | {int(statistics.median(durs))} |")
    if os.environ.get("SKEW_DEBUG"):
        for name in cases:
            st: dict[int, list[int]] = {}
            for dur, recs, sid in tasks.get(name, []):
                st.setdefault(sid, []).append(recs)
            print(name, {k: (len(v), sum(v), max(v)) for k, v in sorted(st.items()) if sum(v) > 0})
    lines.append("")
    with open(os.path.join(ROOT, "docs", "SKEW.md"), "w") as f:
        f.write("\n".join(lines))
    print("\n".join(lines))


if __name__ == "__main__":
    main()
