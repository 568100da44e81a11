"""As-of join (J6): for every left row, the newest right row of the same key
that lies strictly before (or at, if ``strict=False``) the left row's time.

Plan (no custom rule, no cross product, no whole key in one task):

1. Left -> distinct (key, time); right -> one row per (key, time), the row with
   the largest ``tie_break`` (``max_by`` aggregate; both are pre-combined in
   the map tasks, so many rows with one key and time cost one row).
2. These meet in buckets of three fixed levels: day, second, exact time.  A
   window inside (key, second) sees the times of one second; the newest right
   row of each second is carried over the seconds of its day by a window per
   (key, day), and the newest of each day over the days by a window per key.
   No window holds more than the distinct times of a second, the seconds of a
   day or the days of the table, whatever a key's share of the rows.
   DATE times need the last level only.
3. The full left rows join the result on (key, time) as one struct, so AQE
   splits a hot (key, time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.functions.text import ntz_as_utc
from commitlens.operators.joins import skew_safe_join


def _last(col: str) -> Column:
    return F.last(col, ignorenulls=True)


def _match_times(both: DataFrame, by: list[str], date_mode: bool) -> DataFrame:
    """(by, _t, _s, _rv) with side 0/1 rows -> left rows (``_lhs``) with the value as of their time.

    What is known before a day (second) enters the day's (second's) window as
    one more row in front, so the levels need no joins."""
    upto = Window.unboundedPreceding
    if date_mode:
        w = Window.partitionBy(*by).orderBy("_t", "_s").rowsBetween(upto, Window.currentRow)
        return both.withColumn("_m", _last("_rv").over(w)).filter("_lhs").select(*by, "_t", "_m")
    second = both.groupBy(*by, "_day", "_sec").agg(F.max_by("_rv", F.when(F.col("_rv").isNotNull(), F.col("_t"))).alias("_rv"))
    day = second.groupBy(*by, "_day").agg(F.max_by("_rv", F.when(F.col("_rv").isNotNull(), F.col("_sec"))).alias("_rv"))
    w_day = Window.partitionBy(*by).orderBy("_day").rowsBetween(upto, -1)
    before_day = day.withColumn("_rv", _last("_rv").over(w_day)).withColumn("_sec", F.lit(-1).cast("long"))
    w_sec = Window.partitionBy(*by, "_day").orderBy("_sec").rowsBetween(upto, -1)
    before = (second.unionByName(before_day).withColumn("_rv", _last("_rv").over(w_sec)).filter("_sec >= 0")
              .withColumn("_t", F.lit(None).cast(both.schema["_t"].dataType)).withColumn("_s", F.lit(-1)).withColumn("_lhs", F.lit(False)))
    w = Window.partitionBy(*by, "_day", "_sec").orderBy(F.col("_t").asc_nulls_first(), "_s").rowsBetween(upto, Window.currentRow)
    return both.unionByName(before).withColumn("_m", _last("_rv").over(w)).filter("_lhs").select(*by, "_t", "_m")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, *,
              strict: bool = True, how: str = "inner", tie_break: list[str] | None = None) -> DataFrame:
    """Attach to each left row the columns of its as-of right row.

    ``by`` names the key columns (same names on both sides).  Right columns
    other than ``by`` are carried; they must not clash with left names.
    Among right rows with the same time the one with the largest ``tie_break``
    tuple wins.  ``how`` is ``inner`` (drop unmatched left rows) or ``left``.
    Rows with a NULL key or time match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    carried = [c for c in right.columns if c not in by]
    clash = set(carried) & set(left.columns)
    if clash:
        raise ValueError(f"rename right columns first: {sorted(clash)}")
    ltype = left.schema[left_time].dataType
    date_mode = isinstance(ltype, T.DateType) and isinstance(right.schema[right_time].dataType, T.DateType)

    def seconds(c: str) -> Column:
        # zone-free: the result must not depend on the session zone
        col = F.col(c)
        return F.unix_seconds(ntz_as_utc(col) if isinstance(ltype, T.TimestampNTZType) else col.cast("timestamp"))

    def levels(df: DataFrame) -> DataFrame:
        if date_mode:
            return df
        return df.withColumn("_x", seconds("_t")).withColumn("_day", F.floor(F.col("_x") / 86400)) \
            .withColumn("_sec", F.col("_x") - F.col("_day") * 86400).drop("_x")

    l_side, r_side = (0, 1) if strict else (1, 0)   # on equal times the left row comes first iff strict
    order = F.struct(*[F.col(c) for c in tie_break or []]) if tie_break else F.lit(0)
    rv = F.struct(*[F.col(c) for c in carried])
    r = (right.na.drop(subset=[*by, right_time]).withColumn("_t", F.col(right_time).cast(ltype))
         .groupBy(*by, "_t").agg(F.max_by(rv, order).alias("_rv")))
    lk = left.na.drop(subset=[*by, left_time]).select(*by, F.col(left_time).alias("_t")).distinct()
    both = (lk.select(*by, "_t", F.lit(None).cast(r.schema["_rv"].dataType).alias("_rv"), F.lit(l_side).alias("_s"), F.lit(True).alias("_lhs"))
            .unionByName(r.select(*by, "_t", "_rv", F.lit(r_side).alias("_s"), F.lit(False).alias("_lhs"))))
    matched = _match_times(levels(both), by, date_mode).filter(F.col("_m").isNotNull())
    out = skew_safe_join(left.withColumn("_t", F.col(left_time)), matched, [*by, "_t"], how)
    return out.select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in carried])
