"""Readers (S1-S10): CSV with multi-line quoted fields, recursive directory
scans, quarantine of unreadable records, line lists, JSON, whole-text files and
file inventories.  Every reader is one Spark scan with an explicit schema (no
inference pass, no per-file union on the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.functions.text import file_extension, strip_ws
from commitlens.session import checkpoint_root

# Tokens pandas' CSV reader turns into NaN by default (reader option pandas_nulls=True).
PANDAS_NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                      "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _with_pandas_nulls(df: DataFrame, schema: T.StructType) -> DataFrame:
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(PANDAS_NULL_TOKENS), F.lit(None).cast("string")).otherwise(c).alias(f.name)
        cols.append(c)
    return df.select(*cols, *[c for c in df.columns if c not in schema.fieldNames()])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, recursive: bool = False,
             pandas_nulls: bool = False) -> DataFrame:
    """CSV with header and multi-line quoted fields; ``recursive`` scans a tree."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    r = spark.read.schema(st).options(**CSV_OPTIONS)
    if recursive:
        r = r.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    df = r.csv(path)
    return _with_pandas_nulls(df, st) if pandas_nulls else df


def read_csv_quarantine(spark: SparkSession, path: str, schema: T.StructType | str,
                        recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """S3: (good distinct rows, quarantined raw records with their file)."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    st2 = T.StructType(st.fields + [T.StructField("_corrupt_record", T.StringType(), True)])
    r = spark.read.schema(st2).options(**CSV_OPTIONS).option("columnNameOfCorruptRecord", "_corrupt_record")
    if recursive:
        r = r.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    # Spark refuses raw-CSV queries whose pruned scan keeps only the corrupt-record
    # column, so the parse is materialised once with a reliable checkpoint (in the
    # session's shared checkpoint folder, not in executor memory) and both outputs
    # read that.
    checkpoint_root(spark)
    df = r.csv(path).withColumn("_file", F.col("_metadata.file_path")).checkpoint(eager=True)
    good = df.filter(F.col("_corrupt_record").isNull()).select(*st.fieldNames()).distinct()
    bad = df.filter(F.col("_corrupt_record").isNotNull()).select("_file", "_corrupt_record")
    return good, bad


def file_status(spark: SparkSession, path: str, glob: str = "*.csv*") -> DataFrame:
    """S3: (path, length, ``status``) of every file under ``path``, without failing on any.

    The inventory comes from the listing; each file is then read whole with corrupt files skipped, and a file that gave no row is
    ``unreadable`` (a truncated or damaged archive).  Of the others, ``binary`` holds NUL characters, ``encoding`` characters that are
    not UTF-8; the rest is ``ok``.  Files without a byte hold no rows and are not listed.  No file is changed or removed.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length"))
    whole = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").text(path, wholetext=True))
    found = whole.select(F.col("_metadata.file_path").alias("_p"), F.col("value").contains("\x00").alias("_nul"), (~F.is_valid_utf8("value")).alias("_odd"))
    found = found.groupBy("_p").agg(F.max("_nul").alias("_nul"), F.max("_odd").alias("_odd"))
    status = (F.when(F.col("_p").isNull(), "unreadable").when(F.col("_nul"), "binary").when(F.col("_odd"), "encoding").otherwise("ok"))
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  (listing and scan spell local paths differently)
    return listed.join(found, same(F.col("path")) == same(F.col("_p")), "left").select("path", "length", status.alias("status"))


def read_csv_tolerant(spark: SparkSession, path: str, schema: T.StructType | str, glob: str = "*.csv*") -> tuple[DataFrame, DataFrame]:
    """S3: (rows of all files that can be read whole, list of the other files with length and status).

    Rows that a damaged file gives before it breaks off are left out, so a file is either complete or quarantined.
    """
    checkpoint_root(spark)
    files = file_status(spark, path, glob).checkpoint(eager=True)
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    rows = (spark.read.schema(st).options(**CSV_OPTIONS).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .option("ignoreCorruptFiles", "true").csv(path).withColumn("_file", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")))
    bad = files.where("status <> 'ok'")
    broken = bad.select(F.regexp_replace("path", "^file:/+", "file:/").alias("_file"))
    return rows.join(broken, "_file", "left_anti").drop("_file"), bad


def category_from_file(df: DataFrame, name: str = "category") -> DataFrame:
    """category = file name without extension."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def category_from_path(df: DataFrame, pattern: str, name: str = "category") -> DataFrame:
    """S4 for folder layouts: category = first group of ``pattern`` in the file path."""
    return df.withColumn(name, F.nullif(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit("")))


def read_lines(spark: SparkSession, path: str, col: str = "value") -> DataFrame:
    """One stripped string per line; a missing path gives an empty table."""
    schema = T.StructType([T.StructField(col, T.StringType(), True)])
    try:
        df = spark.read.text(path)
    except Exception as e:  # missing input -> empty list, like the source helper
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
    return df.select(strip_ws("value").alias(col))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """JSON lines, or one JSON document per file with ``multi_line=True``."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file under ``path``."""
    # text() sets wholetext itself (default False), so it must be passed here
    df = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def file_inventory(spark: SparkSession, path: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, length, modificationTime, ext) of files under ``path``; the
    content column is pruned, so no file body is read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
          .select("path", "length", "modificationTime"))
    df = df.withColumn("ext", F.lower(file_extension("path")))
    if suffixes:
        df = df.filter(F.col("ext").isin([s.lower() if s.startswith(".") else "." + s.lower() for s in suffixes]))
    return df


def extension_counts(inventory: DataFrame) -> DataFrame:
    """Files per extension."""
    return inventory.groupBy("ext").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


def line_counts(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """Lines per text file (or per partition column ``by``)."""
    df = spark.read.option("recursiveFileLookup", "false").text(path)
    key = F.col(by) if by else F.col("_metadata.file_path")
    return df.groupBy(key.alias(by or "path")).agg(F.count(F.lit(1)).alias("n_lines"))
