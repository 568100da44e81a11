"""Batches of a long scoring job, planned once and worked off with a ledger.

The plan numbers all rows in key order without a single task and cuts them by two bounds, rows and prompt words, so batch
ids do not depend on how the table is partitioned.  The ledger holds the planned batches and, as batches
end, what became of them; a restart takes the open ones only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitlens.functions.text import word_count
from commitlens.operators.numbering import row_numbers, written

MAX_ROWS = 500
MAX_WORDS = 100_000
WAVES = 16          # jobs of a run: what a stop can lose is a part of it in so many
SUB = 1_000_000     # batches into which the words may cut MAX_ROWS rows


def plan_batches(work: DataFrame, key: str, text: str, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> DataFrame:
    """``work`` with ``batch_id``: at most ``max_rows`` rows in key order, and a row begins below ``max_words`` words of its batch.

    So a batch has less than ``max_words`` words before its last prompt; a longer prompt does not split.  ``key`` should be unique.
    """
    numbered, _ = row_numbers(work, [F.col(key).asc()], "_n")
    block = F.floor((F.col("_n") - 1) / max_rows)
    inside = Window.partitionBy("_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)     # max_rows rows at most
    x = numbered.withColumn("_block", block).withColumn("_words", F.coalesce(word_count(text), F.lit(0)))
    before = F.coalesce(F.sum("_words").over(inside), F.lit(0))
    return x.withColumn("batch_id", F.col("_block") * SUB + F.floor(before / max_words)).select(*work.columns, "batch_id")


class BatchLedger:
    """Plan and state of a job at ``path``: ``work`` (rows with ``batch_id``), ``planned`` (one row per batch) and ``ended`` (an entry per end)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def plan(self, planned_rows: DataFrame, text: str) -> None:
        """Write the plan; an unfinished plan is replaced, a finished one is kept (a restart plans nothing anew)."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/planned/_SUCCESS")
        if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return
        # in order of the batches, so that a job skips the files and row groups of others
        planned_rows.repartitionByRange("batch_id").sortWithinPartitions("batch_id").write.mode("overwrite").parquet(f"{self.path}/work")
        rows = self.spark.read.parquet(f"{self.path}/work")
        self._append(rows.limit(0).select("batch_id", F.lit("").alias("state")))
        (rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce(word_count(text), F.lit(0))).alias("n_words"))
         .write.mode("overwrite").parquet(f"{self.path}/planned"))

    def _append(self, ends: DataFrame) -> None:
        ends.write.parquet(f"{self.path}/ended/entry={uuid.uuid4().hex}")

    def ends(self) -> DataFrame:
        return self.spark.read.schema("batch_id long, state string").parquet(f"{self.path}/ended").select("batch_id", "state")

    def status(self) -> DataFrame:
        """(batch_id, n_rows, n_words, ``state``): planned, failed or done; done counts if a batch has ended several times."""
        best = self.ends().groupBy("batch_id").agg(F.min("state").alias("state"))      # 'done' sorts before 'failed'
        return self.spark.read.parquet(f"{self.path}/planned").join(best, "batch_id", "left").withColumn("state", F.coalesce("state", F.lit("planned")))

    def run(self, score: Callable[[DataFrame], DataFrame], sink: str, wave: int = 64, limit: int | None = None) -> None:
        """Score the open batches, ``wave`` of them in one job, into ``sink/batch_id=N``; stop after ``limit`` batches if given.

        A long list of batches is cut into ``WAVES`` jobs of more batches each, so the jobs do not grow in number with the table.
        A job that fails is halved until the batches that fail alone are left; those are entered as failed and stay for the next run.
        A batch that is scored again (its end was not entered) replaces its folder.
        """
        still = self.status().where("state <> 'done'").select("batch_id")
        if limit is not None:
            still = still.orderBy("batch_id").limit(limit)
        still = written(still, "open-batches")      # what this run tries, whatever ends meanwhile
        n = still.count()
        if not n:
            return
        jobs = min(-(-n // wave), WAVES)
        for low, high in self._ranges(still, jobs):
            self._score_or_halve(still.where(F.col("batch_id").between(low, high)), score, sink)

    @staticmethod
    def _ranges(ids: DataFrame, parts: int) -> list[tuple[int, int]]:
        """The ids as ``parts`` ranges with about equally many each: (first, last)."""
        cuts = ids.agg(F.percentile_approx("batch_id", [(i + 1) / parts for i in range(parts)], 1_000_000).alias("c"), F.min("batch_id").alias("low")).first()
        ends = sorted(set(cuts["c"]))
        return list(zip([cuts["low"], *[e + 1 for e in ends[:-1]]], ends))

    def _score_or_halve(self, ids: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str) -> None:
        try:
            self._score(ids, score, sink)
        except Exception:  # a model that fails: find the batch it fails on
            ranges = self._ranges(ids, 2)
            if len(ranges) == 1:
                self._append(ids.select("batch_id", F.lit("failed").alias("state")))
                return
            for low, high in ranges:
                self._score_or_halve(ids.where(F.col("batch_id").between(low, high)), score, sink)

    def _score(self, ids: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str) -> None:
        ends = ids.agg(F.min("batch_id").alias("low"), F.max("batch_id").alias("high")).first()
        work = self.spark.read.parquet(f"{self.path}/work").where(F.col("batch_id").between(ends["low"], ends["high"]))
        rows = work.join(ids, "batch_id", "left_semi").select(*work.columns).repartition("batch_id")
        score(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink)
        self._append(ids.select("batch_id", F.lit("done").alias("state")))
