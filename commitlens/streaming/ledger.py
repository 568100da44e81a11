"""Key ledger beside a sink: exactly-once ingest without streaming state.

A stream of unbounded keys can not keep them all in operator state, and a watermark forgets old ones: a late row
that is new would be lost, a late repeat counted twice.  The ledger keeps the keys of everything accepted as files:

* ``keys``: 128-bit key hashes, one folder per batch, dealt to ``KEY_BUCKETS`` hash buckets;
* ``blooms``: a blocked Bloom filter per batch: a key sets ``PROBES`` bits of one block of ``BLOCK_BITS`` bits;
* ``report``: what each batch brought.

A batch first asks the filters, by a semi join on the block number.  A key that no filter knows is new, which settles
most rows from a few bits per key; only the others are looked up in the key files of their buckets.  So late rows
are accepted if they are new and dropped if they are not, however late they are; the report counts them.

Everything a batch writes goes to folders under its id and reads only earlier batches.  A batch that is replayed
after a failure finds the same ledger and replaces its own folders, so nothing is lost or written twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.sources.sinks import append_batch

KEY_BUCKETS = 64
BLOCK_BITS = 4096
PROBES = 5             # 12 bits of the second hash each
KEYS_PER_BLOCK = 320   # about 13 bits a key
EXPECTED_KEYS = 1 << 20

KEYS = "h1 bigint, h2 bigint, bucket int, batch_id bigint"
BLOOMS = "block bigint, bits array<bigint>, batch_id bigint"
REPORT = ("n_rows bigint, n_repeats_in_batch bigint, n_repeats_earlier bigint, n_accepted bigint, n_late bigint, n_late_accepted bigint, "
          "max_event timestamp, batch_id bigint")


def key_hashes(key: list[str]) -> list[Column]:
    """Two 64-bit hashes of the key columns; a null differs from every value and from a null in another column."""
    parts = [c for k in key for c in (F.col(f"`{k}`"), F.col(f"`{k}`").isNull())]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(17), *parts).alias("h2")]


def _probe(i: int) -> Column:
    return F.shiftright("h2", 12 * i).bitwiseAND(F.lit(BLOCK_BITS - 1))


def _known(bits: Column) -> Column:
    """Are all bits of the row's key set in the block ``bits``?"""
    hit = F.lit(True)
    for i in range(PROBES):
        word = F.get(bits, F.shiftright(_probe(i), 6).cast("int"))
        hit = hit & (F.call_function("getbit", word, _probe(i).bitwiseAND(F.lit(63)).cast("int")) == 1)
    return hit


@dataclass
class KeyLedger:
    """The ledger at ``path``.  ``expected_keys`` sizes the filter: with more keys it answers "perhaps" more often, never wrongly."""
    spark: SparkSession
    path: str
    expected_keys: int = EXPECTED_KEYS

    @property
    def blocks(self) -> int:
        return max(1, -(-self.expected_keys // KEYS_PER_BLOCK))

    def create(self) -> None:
        """Empty tables under batch -1, so that every later read finds some."""
        for name, schema in (("keys", KEYS), ("blooms", BLOOMS), ("report", REPORT)):
            append_batch(self.spark.createDataFrame([], schema).drop("batch_id"), f"{self.path}/{name}", -1)

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return df if before is None else df.where(F.col("batch_id") < before)

    def report(self) -> DataFrame:
        return self._read("report", REPORT)

    def new_rows(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The rows (with ``h1``, ``h2``, one per key) whose key no earlier batch has accepted."""
        block = F.pmod("h1", F.lit(self.blocks))
        blooms = self._read("blooms", BLOOMS, batch_id).withColumnRenamed("block", "_block").drop("batch_id")
        asked = rows.select("h1", "h2").join(blooms, (block == F.col("_block")) & _known(F.col("bits")), "left_semi")
        asked = asked.withColumn("bucket", F.pmod("h1", F.lit(KEY_BUCKETS)).cast("int"))
        seen = asked.join(self._read("keys", KEYS, batch_id).drop("batch_id"), ["bucket", "h1", "h2"], "left_semi").select("h1", "h2")
        return rows.join(seen, ["h1", "h2"], "left_anti")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Enter the keys of ``rows`` under a batch id; entering a batch again replaces it."""
        keys = rows.select("h1", "h2", F.pmod("h1", F.lit(KEY_BUCKETS)).cast("int").alias("bucket"))
        append_batch(keys.repartition("bucket").sortWithinPartitions("bucket", "h1"), f"{self.path}/keys", batch_id)
        bit = rows.select(F.pmod("h1", F.lit(self.blocks)).alias("block"), F.explode(F.array(*[_probe(i) for i in range(PROBES)])).alias("bit"))
        words = bit.groupBy("block", F.shiftright("bit", 6).cast("int").alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("w"))
        filled = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "w"))).alias("m"))
        whole = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)),
                            lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
        append_batch(filled.select("block", whole.alias("bits")), f"{self.path}/blooms", batch_id)

    def compact(self, batch_id: int) -> None:
        """Enter the filters of all batches before ``batch_id`` once more as one, under that id, and empty the single ones.

        To be called between runs; it does no harm if it stops half-way, as filters may overlap.
        """
        old = self._read("blooms", BLOOMS, batch_id)
        ids = [r.batch_id for r in old.select("batch_id").distinct().collect()]
        word = old.select("block", F.posexplode("bits").alias("i", "w")).groupBy("block", "i").agg(F.bit_or("w").alias("w"))
        whole = F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"])
        append_batch(word.groupBy("block").agg(whole.alias("bits")), f"{self.path}/blooms_merged", batch_id)
        merged = self.spark.read.schema(BLOOMS).parquet(f"{self.path}/blooms_merged").where(F.col("batch_id") == batch_id).drop("batch_id")
        append_batch(merged, f"{self.path}/blooms", -1)
        for i in ids:
            if i >= 0:
                append_batch(merged.limit(0), f"{self.path}/blooms", i)


def ingest_batch(df: DataFrame, batch_id: int, ledger: KeyLedger, key: list[str], sink: str, transform: Callable[[DataFrame], DataFrame],
                 event_time: Column | None = None, delay: str = "1 day") -> None:
    """One micro-batch: rows with new keys go through ``transform`` to the sink, their keys to the ledger, the counts to the report.

    Of rows that share a key within the batch the one with the smallest hash over all columns is taken, so a replay takes the same.
    A row is late if its event time is more than ``delay`` before the latest event of earlier batches.
    """
    columns = df.columns
    hashed = df.select("*", *key_hashes(key), (event_time if event_time is not None else F.lit(None).cast("timestamp")).alias("_event"))
    work = f"{ledger.path}/work"
    append_batch(hashed, work, batch_id)         # the source is read once
    rows = ledger.spark.read.schema(hashed.schema).parquet(f"{work}/batch_id={batch_id}")
    whole = F.struct(*[F.col(f"`{c}`") for c in [*columns, "_event"]])
    one = rows.groupBy("h1", "h2").agg(F.min_by(whole, F.xxhash64(*[F.col(f"`{c}`") for c in columns])).alias("r")).select("h1", "h2", "r.*")
    append_batch(ledger.new_rows(one, batch_id), f"{work}_new", batch_id)
    new = ledger.spark.read.schema(one.schema).parquet(f"{work}_new/batch_id={batch_id}")
    append_batch(transform(new.select(*[F.col(f"`{c}`") for c in columns])), sink, batch_id)
    ledger.add(new, batch_id)
    last = ledger._read("report", REPORT, batch_id).agg(F.unix_micros(F.max("max_event")).alias("t")).first().t
    late = F.lit(False) if last is None else F.coalesce(F.col("_event") < F.timestamp_micros(F.lit(last)) - F.expr(f"interval {delay}"), F.lit(False))
    came = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late"), F.unix_micros(F.max("_event")).alias("t")).first()
    n_keys = one.count()
    kept = new.agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late")).first()
    counts = ledger.spark.createDataFrame([(came.n, came.n - n_keys, n_keys - kept.n, kept.n, came.late, kept.late, came.t)],
                                          "n_rows long, n_repeats_in_batch long, n_repeats_earlier long, n_accepted long, n_late long, n_late_accepted long, t long")
    append_batch(counts.withColumn("max_event", F.timestamp_micros("t")).drop("t"), f"{ledger.path}/report", batch_id)
