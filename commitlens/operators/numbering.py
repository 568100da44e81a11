"""Row numbers over a whole table without a single task.

Rows are dealt by range and sorted inside the partitions; a row's number is its place there plus the rows of the
partitions before.  Only one count per partition is summed up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number", counted: str | None = None) -> tuple[DataFrame, int]:
    """(``df`` with a long column ``name`` that counts the rows from 1 in ``order``, how many rows there are).

    With ``counted`` (a boolean column) the second value counts the rows where it is true.
    ``order`` should tell rows apart: rows that agree in it are numbered in any order and can not be
    dealt to different tasks.  The result does not depend on the partitioning of ``df``.
    """
    place = F.col("_place")
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(place, 33)
    n = F.count_if(F.col(counted)) if counted else F.count(F.lit(1))
    parts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), n.alias("_counted"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "parts")   # one row per partition
    total = parts.agg(F.coalesce(F.sum("_counted"), F.lit(0)).alias("n")).first()["n"]
    out = rows.join(parts.select("_part", "_before"), part == F.col("_part"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      (F.col("_before") + place.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name)), total
