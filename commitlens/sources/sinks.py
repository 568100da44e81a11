"""Sinks (S11, S12): tables are written to new paths, never over an input."""

from __future__ import annotations

from pyspark.sql import DataFrame

from commitlens.sources.readers import CSV_OPTIONS


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Overwrite a Parquet table at ``path`` (which must not be an input)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    """CSV export with a header; quotes/escapes round-trip multi-line text."""
    opts = {k: v for k, v in CSV_OPTIONS.items() if k in ("header", "quote", "escape")}
    # the writer trims values by default; keep text byte-exact
    opts.update(ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    df.write.mode("overwrite").options(**opts).csv(path)
    return path


def append_batch(df: DataFrame, path: str, batch_id: int) -> str:
    """One folder ``batch_id=N`` per batch; writing a batch again replaces it,
    so a replay never duplicates rows.  Readers get ``batch_id`` back as a column."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return path


def cut_copy(spark, source: str, target: str, share: float) -> None:
    """Copy the data files of a folder, each broken off after ``share`` of its bytes (damaged deliveries for S3)."""
    hadoop, io = spark._jvm.org.apache.hadoop, spark._jvm.org.apache.commons.io.IOUtils
    conf = spark._jsc.hadoopConfiguration()
    top = hadoop.fs.Path(source)
    fs = top.getFileSystem(conf)
    for f in fs.listStatus(top):
        if f.getPath().getName().startswith("part-"):
            out = fs.create(hadoop.fs.Path(target, f.getPath().getName()), True)
            whole = fs.open(f.getPath())
            io.copyLarge(whole, out, 0, int(f.getLen() * share))
            whole.close()
            out.close()
