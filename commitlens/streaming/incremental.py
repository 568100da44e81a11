"""Incremental forms (R1-R4) on Structured Streaming with ``availableNow``.

The source pipeline resumes by hand (success logs, batch numbers, pickled
"handled" lists).  Here the streaming checkpoint records which input files
were consumed, and sinks are idempotent per batch id, so a rerun on the same
checkpoint reads nothing new and a lost executor only replays its batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.functions.text import ntz_as_utc
from commitlens.sources.sinks import append_batch
from commitlens.streaming.ledger import EXPECTED_KEYS, KeyLedger, ingest_batch


def _run(writer) -> dict[int, int]:
    """Consume all available input, however long it takes.

    Returns, per batch id, the rows that arrived behind the watermark and
    were dropped by the stateful operators."""
    q = writer.trigger(availableNow=True).start()
    late: dict[int, int] = {}

    def note() -> None:
        for p in q.recentProgress:
            late[p.batchId] = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    while not q.awaitTermination(5):   # polled only so that no progress report is missed
        note()
    note()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return late


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, max_bytes_per_trigger: str | None = None) -> DataFrame:
    """Files of ``path`` as a stream.  By default everything available is one
    batch; a byte budget ("512g") or a file count bounds the batches."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return r.load(path)


def _through_ledger(spark: SparkSession, source: str, schema: T.StructType, key: list[str], sink: str, checkpoint: str,
                    transform: Callable[[DataFrame], DataFrame], event_time: str | None = None, delay: str = "1 day",
                    expected_keys: int = EXPECTED_KEYS, max_files_per_trigger: int | None = None, max_bytes_per_trigger: str | None = None) -> str:
    ledger = KeyLedger(spark, f"{sink}_ledger", expected_keys)
    ledger.create()
    event = None
    if event_time:
        # an NTZ wall clock is read as UTC (zone-free)
        ntz = isinstance(schema[event_time].dataType, T.TimestampNTZType)
        event = ntz_as_utc(event_time) if ntz else F.col(event_time).cast("timestamp")

    def batch(df: DataFrame, batch_id: int) -> None:
        ingest_batch(df, batch_id, ledger, key, sink, transform, event, delay)

    s = file_stream(spark, source, schema, max_files_per_trigger=max_files_per_trigger, max_bytes_per_trigger=max_bytes_per_trigger)
    _run(s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint))
    return sink


def ingest_dedup(spark: SparkSession, source: str, schema: T.StructType, key: list[str], sink: str,
                 checkpoint: str, event_time: str | None = None, delay: str = "1 day",
                 expected_keys: int = EXPECTED_KEYS, max_files_per_trigger: int | None = None,
                 max_bytes_per_trigger: str | None = None) -> str:
    """Ingest newly arrived files once and drop re-delivered rows by key, however late they come.

    Keys are kept in a ledger beside the sink (``<sink>_ledger``), not in streaming state: a late row is accepted if its key
    is new.  ``event_time`` and ``delay`` only tell which rows the report (:func:`ingest_report`) counts as late.
    """
    return _through_ledger(spark, source, schema, key, sink, checkpoint, lambda df: df, event_time, delay, expected_keys,
                           max_files_per_trigger, max_bytes_per_trigger)


def ingest_report(spark: SparkSession, sink: str) -> DataFrame:
    """Per batch of a ledger sink: rows, repeats within the batch and of earlier batches, accepted and late rows."""
    return KeyLedger(spark, f"{sink}_ledger").report()


def parse_resume(spark: SparkSession, source: str, schema: T.StructType, key: str, sink: str, checkpoint: str,
                 parse: Callable[[DataFrame], DataFrame], expected_keys: int = EXPECTED_KEYS, max_files_per_trigger: int | None = None,
                 max_bytes_per_trigger: str | None = None) -> str:
    """Parse newly arrived pages once and append the parsed rows; the ledger is the
    "handled" list, so a page handled before is skipped, also across deliveries."""
    return _through_ledger(spark, source, schema, [key], sink, checkpoint, parse, None, "1 day", expected_keys,
                           max_files_per_trigger, max_bytes_per_trigger)


def score_resume(spark: SparkSession, source: str, schema: T.StructType, key: str, sink: str,
                 checkpoint: str, score: Callable[[DataFrame], DataFrame], expected_keys: int = EXPECTED_KEYS,
                 max_files_per_trigger: int | None = None, max_bytes_per_trigger: str | None = None) -> str:
    """R2: resume long scoring.

    Keys scored in earlier batches are in the ledger, and every micro-batch overwrites its
    own ``batch_id=N`` folder, so a batch replayed after a failure replaces its
    partial output instead of appending twice.  No batch scans the sink.
    """
    return _through_ledger(spark, source, schema, [key], sink, checkpoint, score, None, "1 day", expected_keys,
                           max_files_per_trigger, max_bytes_per_trigger)


def running_counts(spark: SparkSession, source: str, schema: T.StructType, time_col: str, group: str,
                   sink: str, checkpoint: str, window: str = "1 day", delay: str = "1 day",
                   max_files_per_trigger: int | None = None,
                 max_bytes_per_trigger: str | None = None) -> str:
    """Label counts per time window kept up to date as rows arrive.

    Each micro-batch overwrites its own ``batch_id=N`` folder with the windows
    it changed (update mode); readers take the latest batch per window.  Rows
    behind the watermark (``delay``) cannot be counted any more; how many
    there were goes to ``<sink>_late`` (batch, rows), so they are never lost
    silently.
    """
    s = file_stream(spark, source, schema, max_files_per_trigger=max_files_per_trigger,
                    max_bytes_per_trigger=max_bytes_per_trigger)
    ntz = isinstance(schema[time_col].dataType, T.TimestampNTZType)
    # watermarks need TIMESTAMP; an NTZ wall clock is read as UTC (zone-free)
    s = s.withColumn("_ts", ntz_as_utc(time_col) if ntz else F.col(time_col))
    keys = [F.window("_ts", window).alias("w"), F.col(group)]
    if ntz:  # report the window start on the NTZ clock (functionally dependent on w)
        micros = F.unix_micros("_ts")
        step = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00 UTC' + INTERVAL '{window}')")
        off = F.pmod(micros, step)
        keys.append((F.col(time_col) - F.make_dt_interval(secs=(off / F.lit(1_000_000)).cast("decimal(18,6)")))
                    .alias("_ws"))
    agg = s.withWatermark("_ts", delay).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def batch(df: DataFrame, batch_id: int) -> None:
        start = F.col("_ws") if ntz else F.col("w.start")
        append_batch(df.select(start.alias("window_start"), group, "n"), sink, batch_id)

    late = _run(agg.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint))
    report = [(b, n) for b, n in sorted(late.items()) if n]
    spark.createDataFrame(report, "batch bigint, n_late bigint").write.mode("append").parquet(f"{sink}_late")
    return sink


def running_item_counts(spark: SparkSession, source: str, schema: T.StructType, key: str,
                        items: Callable[[], Column], sink: str, checkpoint: str, name: str = "label",
                        max_files_per_trigger: int | None = None,
                 max_bytes_per_trigger: str | None = None) -> str:
    """R4 without time windows: counts of the items (e.g. parsed labels) of
    every distinct key seen so far, kept up to date as files arrive.  State is
    one row per item plus the key dedup (RocksDB); each batch overwrites its
    own ``batch_id=N`` folder with the counts it changed."""
    s = file_stream(spark, source, schema, max_files_per_trigger=max_files_per_trigger,
                    max_bytes_per_trigger=max_bytes_per_trigger).dropDuplicates([key])
    counts = s.select(F.explode(items()).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))

    def batch(df: DataFrame, batch_id: int) -> None:
        append_batch(df, sink, batch_id)

    _run(counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint))
    return sink


def latest_item_counts(spark: SparkSession, sink: str, name: str = "label") -> DataFrame:
    """Current counts from a ``running_item_counts`` sink."""
    return spark.read.parquet(sink).groupBy(name).agg(F.max_by("n", "batch_id").alias("n"))


def latest_counts(spark: SparkSession, sink: str, group: str) -> DataFrame:
    """Current counts from an R4 sink: the last batch's value per (window, group)."""
    df = spark.read.parquet(sink)
    last = df.groupBy("window_start", group).agg(F.max_by("n", "batch_id").alias("n"))
    return last
