"""Helpers shared by the operators of this subpackage (column expressions, joins, scratch folders).

Fixed definitions used everywhere below:

* white space is the ASCII set ``[\\x20\\x09-\\x0D]``; a word is a maximal run of other characters;
* lower case means A-Z only (``ascii_lower``), other letters stay as they are;
* internal column names start with ``_x_`` so that they never clash with columns of the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import commitlens
from commitlens.session import scratch_path

# functions for the Python workers travel with the task: the package need not be installed there
cloudpickle.register_pickle_by_value(commitlens)

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; works for any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back (cuts lineage, survives lost executors)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body`` (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def strip_white(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Array of the words of a text (native; linear in the text)."""
    return F.array_remove(F.split(F.translate(c, WHITE[1:], " " * (len(WHITE) - 1)), " ", -1), "")


def lines(c: Column) -> Column:
    """The \\n-separated lines; an empty text is one empty line."""
    return F.split(c, "\n", -1)


def digest(c: Column) -> Column:
    """128-bit content key of a string, 16 bytes."""
    return F.unhex(F.md5(c))


def row_key(text: Column) -> Column:
    """Tells rows that repeat an id but differ in text apart."""
    return F.xxhash64(text_or_empty(text))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that adaptive execution may split on hot keys.

    ``right`` usually comes out of an aggregate on the same keys.  Joining on
    the plain columns would reuse that partitioning, and then a hot key of
    ``left`` cannot be split; joining on a struct of them adds an exchange to both sides.
    """
    names = [f"_x_r_{k}" for k in keys]
    right = right.withColumnsRenamed(dict(zip(keys, names)))
    on = F.struct(*[left[k].alias(k) for k in keys]) == F.struct(*[right[n].alias(k) for k, n in zip(keys, names)])
    return left.join(right, on, how).drop(*names)


def with_columns_last(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Set or replace columns; an input column of the same name (any case) is replaced."""
    lowered = {n.lower() for n in new}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered]
    return df.select(*rest, *[v.alias(n) for n, v in new.items()])


def kept_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the positions ``gone`` (from 0); unchanged if that is null.

    Linear in the number of lines: kept positions come from ``array_except`` (a hash set), not from a search per line.
    """
    rest = let(lines(text_or_empty(text)), lambda ls: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)), "\n"))
    return F.when(gone.isNull(), text).otherwise(rest)


def drop_lines(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str,
               n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """Remove the lines at given positions and put the rest together again by position.

    ``drops`` has ``_x_id``, ``_x_rk`` (``row_key`` of the text) and ``_x_pos``
    (from 0; repeats do no harm).  Only these numbers are grouped; each text moves
    once, for the join.
    A document that loses nothing keeps its text as it is (a null text stays null).
    """
    gone = drops.groupBy("_x_id", "_x_rk").agg(F.collect_set("_x_pos").alias("_x_gone"))
    base = docs.withColumns({"_x_id": F.col(f"`{id_col}`"), "_x_rk": row_key(F.col(f"`{text_col}`"))})
    gone = gone.withColumnsRenamed({"_x_id": "_x_gid", "_x_rk": "_x_grk"})
    joined = base.join(gone, (F.col("_x_id") == F.col("_x_gid")) & (F.col("_x_rk") == F.col("_x_grk")), "left")
    text = F.col(f"`{text_col}`")
    new = {text_col: kept_lines(text, F.col("_x_gone"))}
    if n_lines:
        new[n_lines] = F.size(lines(text_or_empty(text))).cast("long")
    if n_dropped:
        new[n_dropped] = F.coalesce(F.size("_x_gone"), F.lit(0)).cast("long")
    order = [c for c in docs.columns]
    out = with_columns_last(joined, new).drop("_x_id", "_x_rk", "_x_gid", "_x_grk", "_x_gone")
    return out.select(*[F.col(f"`{c}`") for c in order if c in out.columns],
                      *[F.col(f"`{c}`") for c in out.columns if c not in order])
