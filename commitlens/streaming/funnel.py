"""Running funnel with retraction (R4 for A1): verdicts may change after they were counted.

State is the last verdict of every row, in a versioned table dealt by commit, so all rows of a commit are in one
bucket.  A batch rewrites the buckets it touches and compares each touched commit's place in the funnel before and after:
the differences, positive or negative, are the batch's output, and the funnel is their sum.  Distinct commits stay exact, as a
commit's rows are counted together.  Version N + 1 of the state is always made from version N, so a replayed batch
gives the same differences and replaces its folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.sources.sinks import append_batch
from commitlens.sources.versioned import BUCKETS, VersionedTable
from commitlens.streaming.incremental import _run, file_stream


def last_verdicts(table: VersionedTable, old: DataFrame, rows: DataFrame, key: str, row_key: list[str]) -> DataFrame:
    """The last verdict of every row, dealt for ``table``: one shuffle serves the grouping and the write."""
    both = table.deal(old.unionByName(rows))
    last = both.groupBy("bucket", "_part", key, *row_key).agg(F.max(F.struct("_order", "_flags")).alias("m"))
    return last.select("bucket", key, *row_key, "m._order", "m._flags")


def funnel_changes(old: DataFrame, new: DataFrame, key: str, names: list[str], cap: tuple[str, str, int] | None) -> DataFrame:
    """(stage_order, stage, ``d_rows``, ``d_commits``): what changed between two states of the same commits."""
    labels = names + ([cap[0]] if cap else [])
    # both states are counted in one grouping, which also takes null keys as one commit
    both = old.select(key, "_flags", F.lit(False).alias("_now")).unionByName(new.select(key, "_flags", F.lit(True).alias("_now")))
    sides = {"b": ~F.col("_now"), "a": F.col("_now")}
    bit = lambda i: F.call_function("getbit", F.col("_flags"), F.lit(i)).cast("long")
    counts = both.groupBy(key).agg(*[F.sum(F.when(at, bit(i)).otherwise(0)).alias(f"_{s}{i}") for s, at in sides.items() for i in range(len(names))])

    def rows(side: str) -> Column:
        of = [F.col(f"_{side}{i}") for i in range(len(names))]
        if cap:
            r = of[names.index(cap[1])]
            of.append(F.when(r <= cap[2], r).otherwise(F.lit(0).cast("long")))
        return F.array(*of).alias(side)

    moved = counts.select(rows("b"), rows("a")).where(F.col("b") != F.col("a"))
    each = moved.select(F.explode(F.arrays_zip("b", "a", F.array(*[F.lit(i) for i in range(len(labels))]).alias("i"))).alias("s"))
    changed = each.select(F.col("s.i").alias("stage_order"), (F.col("s.a") - F.col("s.b")).alias("r"),
                          ((F.col("s.a") > 0).cast("long") - (F.col("s.b") > 0).cast("long")).alias("k"))
    name = F.get(F.array(*[F.lit(x) for x in labels]), F.col("stage_order"))
    return changed.groupBy("stage_order").agg(F.sum("r").alias("d_rows"), F.sum("k").alias("d_commits")).withColumn("stage", name)


def running_funnel(spark: SparkSession, source: str, schema: T.StructType, key: str, row_key: list[str], order: str, stages: list[tuple[str, Column]],
                   sink: str, checkpoint: str, cap: tuple[str, str, int] | None = None, buckets: int = BUCKETS, max_files_per_trigger: int | None = None,
                   max_bytes_per_trigger: str | None = None) -> str:
    """Keep a funnel up to date while rows and changed verdicts arrive.

    ``row_key`` tells the rows of a ``key`` apart; of several deliveries of a row the one with the largest ``order`` counts (ties: the one with
    more stages), also if it comes first.  ``stages`` and ``cap`` are as in ``aggregates.funnel_flags``.  ``sink`` gets each batch's changes.
    """
    names = [n for n, _ in stages]
    table = VersionedTable(spark, f"{sink}_state", [key], buckets)
    flags = sum((F.coalesce(c, F.lit(False)).cast("long") * (1 << i) for i, (_, c) in enumerate(stages)), F.lit(0).cast("long"))

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        return last_verdicts(table, old, rows, key, row_key)

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.select(key, *row_key, F.col(order).alias("_order"), flags.alias("_flags"))
        append_batch(rows, f"{sink}_work", batch_id)          # the source is read once
        rows = spark.read.schema(rows.schema).parquet(f"{sink}_work/batch_id={batch_id}")
        if batch_id == 0:
            table.create(rows.limit(0), 0)
        version = table.rewrite(rows, merge, base=batch_id, dealt=True)
        at = table.touched(rows)
        append_batch(funnel_changes(table.read(batch_id, at), table.read(version, at), key, names, cap), sink, batch_id)

    s = file_stream(spark, source, schema, max_files_per_trigger=max_files_per_trigger, max_bytes_per_trigger=max_bytes_per_trigger)
    _run(s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint))
    return sink


def current_funnel(spark: SparkSession, sink: str) -> DataFrame:
    """The funnel after all batches, as ``aggregates.funnel_flags`` gives it (stages that nothing has reached are left out)."""
    total = spark.read.parquet(sink).groupBy("stage_order", "stage").agg(F.sum("d_rows").alias("n_rows"), F.sum("d_commits").alias("n_commits"))
    return total
