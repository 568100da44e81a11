"""Adapters: shape the driver's tables into the commit-mining domain tables.

Each adapter is a lazy DataFrame over the given parquet tables, so its work
grows with them.  The SQL form of each adapter (used by the DuckDB oracle) is
kept next to it in ``ADAPTER_SQL``; both forms must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to all shuffle partitions, for joins whose rows grow wide afterwards.

    Partitions that Spark joins up by their size before the join can hold many times that size after it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _project(custkey) -> F.Column:
    return F.concat(F.lit("https://github.com/o"), (custkey % 50).cast("string"),
                    F.lit("/r"), custkey.cast("string"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit x changed file: order = commit, customer = project, line item = file."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    # some commits carry a long message of their own: the text of a document
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_text"))
    k = F.col("o_orderkey")
    # orders without a text keep their own key, which spreads them over the tasks; null keys would all meet in one
    long = k % 25 == 4
    o = o.join(docs, long & (F.when(long, F.floor(k / 15)).otherwise(k) == F.col("doc_id")), "left")
    j = o.join(spread(li, "l_orderkey"), F.col("l_orderkey") == k)
    title = (F.when(k % 37 == 1, F.concat(F.lit("Merge pull request #"), (k % 50).cast("string"), F.lit(" from a/b")))
             .when(k % 37 == 2, F.concat(F.lit("v"), (k % 9).cast("string"), F.lit(".0")))
             .when(k % 37 == 3, F.concat(F.lit("Release "), (k % 9).cast("string")))
             .when(k % 37 == 4, F.lit("Update Kotlin to version 1.9"))
             .when(k % 12 == 0, F.lit("Update README.md"))
             .when(k % 12 == 1, F.concat(F.lit("version 1."), (k % 9).cast("string")))
             .when(k % 12 == 2, F.lit("Merge branch 'master'"))
             .when(k % 12 == 3, F.lit("REFACTORING"))
             .when(k % 12 == 4, F.lit("added build.xml files"))
             .when(k % 12 == 5, F.lit("remove .DS_Store files"))
             .when(k % 12 == 6, F.lit("Fix café crash"))
             .when(k % 12 == 7, F.lit("Fix memory leak in player"))
             .when(k % 12 == 8, F.lit("Reduce battery drain"))
             .when(k % 12 == 9, F.lit("Speed up list scrolling"))
             .when(k % 12 == 10, F.lit("Add dark theme")))
    desc = (F.when(k % 5 < 3, F.lit(None).cast("string"))
            .when(k % 5 == 3, F.lit("Avoid work on the main thread"))
            .when(F.col("_text").isNotNull(), F.col("_text"))
            .otherwise(F.concat(F.lit("See issue "), (k % 7).cast("string"))))
    git = _project(F.col("o_custkey"))
    return j.select(
        git.alias("git_link"),
        F.concat(git, F.lit("/commit/"), k.cast("string")).alias("commit_link"),
        title.alias("commit_title"),
        desc.alias("commit_description"),
        F.concat(F.lit("src/F"), F.col("l_linenumber").cast("string"), F.lit(".java")).alias("commit_diff_file"),
        F.when(k % 41 != 0, F.col("o_orderdate").cast("date")).alias("commit_date"),
    )


def release_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """release asset rows (project x version x file) from finished orders."""
    o = (table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
         .select("o_orderkey", "o_custkey", "o_orderdate"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    j = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    k, ln = F.col("o_orderkey"), F.col("l_linenumber")
    sel = (ln + k) % 6
    name = (F.when(sel == 0, F.lit("app-universal-release.apk"))
            .when(sel == 1, F.lit("mobile.apk"))
            .when(sel == 2, F.concat(F.lit("app-"), ln.cast("string"), F.lit(".apk")))
            .when(sel == 3, F.lit("html.zip"))
            .when(sel == 4, F.concat(F.lit("src-"), k.cast("string"), F.lit(".zip")))
            .otherwise(F.lit("notes.txt")))
    version = F.concat(F.when(k % 3 == 0, F.lit("v")).otherwise(F.lit("Release ")),
                       (1 + k % 4).cast("string"), F.lit("."), (k % 10).cast("string"))
    return j.select(
        _project(F.col("o_custkey")).alias("git_link"),
        version.alias("apk_version"),
        F.col("o_orderdate").cast("date").alias("release_date"),
        name.alias("download_file_name"),
        F.concat(F.lit("https://dl.example/"), k.cast("string"), F.lit("/"), ln.cast("string"))
        .alias("download_link"),
    )


def store_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store listing versions (one row per order in progress): the second release source."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P")
    k = F.col("o_orderkey")
    version = F.concat(F.when(k % 5 == 0, F.lit("v")).otherwise(F.lit("")),
                       (1 + k % 4).cast("string"), F.lit("."), (k % 10).cast("string"))
    return o.select(
        _project(F.col("o_custkey")).alias("git_link"),
        version.alias("apk_version"),
        F.col("o_orderdate").cast("date").alias("release_date"),
        F.concat(F.lit("https://store.example/apk/"), k.cast("string")).alias("apk_download_link"),
        F.concat(F.lit("https://store.example/src/"), k.cast("string")).alias("source_code_download_link"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classification answers, one per commit, incl. N/A, ignored and unknown labels."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    types = (F.when(k % 8 == 0, F.lit("N/A"))
             .when(k % 8 == 1, F.lit("Energy Consumption, Memory Consumption"))
             .when(k % 8 == 2, F.lit("Responsiveness"))
             .when(k % 8 == 3, F.lit("Efficiency, Responsiveness"))
             .when(k % 8 == 4, F.lit("CPU Load"))
             .when(k % 8 == 5, F.lit("Build Time, Security"))
             .when(k % 8 == 6, F.lit("Network Traffic"))
             .when(k % 16 == 7, F.lit("Unheard Of, N/A"))
             .otherwise(F.lit("Unheard Of")))
    causes = (F.when(k % 3 == 0, F.lit("N/A")).when(k % 3 == 1, F.lit("resource leak"))
              .otherwise(F.lit("latency, wakelock misuse")))
    answer = F.concat(F.lit("###Optimized_Performance_Issue_Type\n    ["), types,
                      F.lit("]\n\n\n###Root_Causes\n    ["), causes, F.lit("]"))
    git = _project(F.col("o_custkey"))
    return o.select(F.concat(git, F.lit("/commit/"), k.cast("string")).alias("commit_link"),
                    answer.alias("answer"))


def _path(did) -> F.Column:
    return F.concat(F.lit("f"), did.cast("string"), F.when(did % 13 == 0, F.lit(".apk")).otherwise(F.lit(".java")))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file text per (commit, side, path); the release side is sometimes changed or
    missing, some files did not exist before, some are binary."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    sides = F.explode(F.array(F.lit("before"), F.lit("after"), F.lit("release")))
    did = F.col("doc_id")
    d = d.select("doc_id", "text", sides.alias("side")).filter((F.col("side") != "before") | (did % 10 != 6))
    content = (F.when((F.col("side") == "release") & (did % 4 == 0), F.concat(F.lit("changed "), F.col("text")))
               .when((F.col("side") == "release") & (did % 7 == 0), F.lit(None).cast("string"))
               .otherwise(F.col("text")))
    return d.select(F.concat(F.lit("c"), (did % 100).cast("string")).alias("commit_link"), "side",
                    _path(did).alias("path"), content.alias("content"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """changed file with a unified-diff patch and the commit message."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    j = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    ln = F.col("l_linenumber").cast("string")
    qty = F.col("l_quantity").cast("long")
    patch = F.concat(F.lit("@@ -"), ln, F.lit(",1 +"), ln, F.lit(",2 @@\n-qty "), qty.cast("string"),
                     F.lit("\n+qty "), (qty + 1).cast("string"), F.lit("\n+flag "), F.col("l_returnflag"),
                     F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("\n@@ -4"), ln, F.lit(" +5"), ln, F.lit(",3 @@ void f()\n-x"))).otherwise(""))
    git = _project(F.col("o_custkey"))
    return j.select(F.concat(git, F.lit("/commit/"), F.col("o_orderkey").cast("string")).alias("commit_link"),
                    F.concat(F.lit("src/F"), ln, F.lit(".java")).alias("file_name"),
                    patch.alias("patch"),
                    F.concat(F.lit("Commit "), F.col("o_orderkey").cast("string"), F.lit("\npriority "),
                             F.col("o_orderpriority")).alias("message"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """changed-file rows of the snapshot commits with their deleted and added line
    numbers: none, the first and last, every third, or one beyond the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    did, n = F.col("doc_id"), F.size(F.split("text", "\n", -1))
    none = F.array().cast("array<int>")
    deleted = (F.when(did % 11 == 5, F.array(n + 5)).when(did % 3 == 0, none).when(did % 3 == 1, F.array(F.lit(1), n))
               .otherwise(F.sequence(F.lit(1), n, F.lit(3))))
    added = F.when((did % 3 == 0) & (did % 2 == 0), F.sequence(F.lit(1), n)).otherwise(none)
    return d.select(F.concat(F.lit("c"), (did % 100).cast("string")).alias("commit_link"), _path(did).alias("path"),
                    deleted.alias("deleted_lines"), added.alias("added_lines"))


# --- the same adapters as DuckDB SQL (for oracle CTEs) ------------------------

_PROJECT_SQL = "concat('https://github.com/o', cast(o_custkey % 50 as varchar), '/r', cast(o_custkey as varchar))"

_PATH_SQL = "concat('f', cast(doc_id as varchar), case when doc_id % 13 = 0 then '.apk' else '.java' end)"

ADAPTER_SQL = {
    "commits": f"""select {_PROJECT_SQL} as git_link,
 concat({_PROJECT_SQL}, '/commit/', cast(o_orderkey as varchar)) as commit_link,
 case when o_orderkey % 37 = 1 then concat('Merge pull request #', cast(o_orderkey % 50 as varchar), ' from a/b')
  when o_orderkey % 37 = 2 then concat('v', cast(o_orderkey % 9 as varchar), '.0') when o_orderkey % 37 = 3 then concat('Release ', cast(o_orderkey % 9 as varchar))
  when o_orderkey % 37 = 4 then 'Update Kotlin to version 1.9' else case o_orderkey % 12 when 0 then 'Update README.md' when 1 then concat('version 1.', cast(o_orderkey % 9 as varchar))
  when 2 then 'Merge branch ''master''' when 3 then 'REFACTORING' when 4 then 'added build.xml files'
  when 5 then 'remove .DS_Store files' when 6 then 'Fix café crash' when 7 then 'Fix memory leak in player'
  when 8 then 'Reduce battery drain' when 9 then 'Speed up list scrolling' when 10 then 'Add dark theme' else null end end as commit_title,
 case when o_orderkey % 5 < 3 then null when o_orderkey % 5 = 3 then 'Avoid work on the main thread' when msg.text is not null then msg.text
  else concat('See issue ', cast(o_orderkey % 7 as varchar)) end as commit_description,
 concat('src/F', cast(l_linenumber as varchar), '.java') as commit_diff_file,
 case when o_orderkey % 41 <> 0 then cast(o_orderdate as date) end as commit_date
from orders join lineitem on l_orderkey = o_orderkey left join documents msg on o_orderkey % 25 = 4 and msg.doc_id = o_orderkey // 15""",
    "release_assets": f"""select {_PROJECT_SQL} as git_link,
 concat(case when o_orderkey % 3 = 0 then 'v' else 'Release ' end, cast(1 + o_orderkey % 4 as varchar), '.', cast(o_orderkey % 10 as varchar)) as apk_version,
 cast(o_orderdate as date) as release_date,
 case (l_linenumber + o_orderkey) % 6 when 0 then 'app-universal-release.apk' when 1 then 'mobile.apk'
  when 2 then concat('app-', cast(l_linenumber as varchar), '.apk') when 3 then 'html.zip'
  when 4 then concat('src-', cast(o_orderkey as varchar), '.zip') else 'notes.txt' end as download_file_name,
 concat('https://dl.example/', cast(o_orderkey as varchar), '/', cast(l_linenumber as varchar)) as download_link
from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F'""",
    "store_releases": f"""select {_PROJECT_SQL} as git_link,
 concat(case when o_orderkey % 5 = 0 then 'v' else '' end, cast(1 + o_orderkey % 4 as varchar), '.', cast(o_orderkey % 10 as varchar)) as apk_version,
 cast(o_orderdate as date) as release_date,
 concat('https://store.example/apk/', cast(o_orderkey as varchar)) as apk_download_link,
 concat('https://store.example/src/', cast(o_orderkey as varchar)) as source_code_download_link
from orders where o_orderstatus = 'P'""",
    "answers": f"""select concat({_PROJECT_SQL}, '/commit/', cast(o_orderkey as varchar)) as commit_link,
 concat('###Optimized_Performance_Issue_Type', chr(10), '    [', case o_orderkey % 8 when 0 then 'N/A'
  when 1 then 'Energy Consumption, Memory Consumption' when 2 then 'Responsiveness' when 3 then 'Efficiency, Responsiveness'
  when 4 then 'CPU Load' when 5 then 'Build Time, Security' when 6 then 'Network Traffic'
  else case when o_orderkey % 16 = 7 then 'Unheard Of, N/A' else 'Unheard Of' end end, ']',
  chr(10), chr(10), chr(10), '###Root_Causes', chr(10), '    [',
  case o_orderkey % 3 when 0 then 'N/A' when 1 then 'resource leak' else 'latency, wakelock misuse' end, ']') as answer
from orders""",
    "diffs": f"""select concat({_PROJECT_SQL}, '/commit/', cast(o_orderkey as varchar)) as commit_link,
 concat('src/F', cast(l_linenumber as varchar), '.java') as file_name,
 concat('@@ -', cast(l_linenumber as varchar), ',1 +', cast(l_linenumber as varchar), ',2 @@', chr(10), '-qty ',
  cast(cast(l_quantity as bigint) as varchar), chr(10), '+qty ', cast(cast(l_quantity as bigint) + 1 as varchar),
  chr(10), '+flag ', l_returnflag, case when l_linenumber % 2 = 0 then concat(chr(10), '@@ -4', cast(l_linenumber as varchar), ' +5',
   cast(l_linenumber as varchar), ',3 @@ void f()', chr(10), '-x') else '' end) as patch,
 concat('Commit ', cast(o_orderkey as varchar), chr(10), 'priority ', o_orderpriority) as message
from orders join lineitem on l_orderkey = o_orderkey""",
    "changes": f"""select concat('c', cast(doc_id % 100 as varchar)) as commit_link, {_PATH_SQL} as path,
 case when doc_id % 11 = 5 then [n + 5] when doc_id % 3 = 0 then [] when doc_id % 3 = 1 then [1, n] else range(1, n + 1, 3) end as deleted_lines,
 case when doc_id % 3 = 0 and doc_id % 2 = 0 then range(1, n + 1) else [] end as added_lines
from (select doc_id, len(string_split(text, chr(10))) as n from documents)""",
    "snapshot": f"""select concat('c', cast(doc_id % 100 as varchar)) as commit_link, side, {_PATH_SQL} as path,
 case when side = 'release' and doc_id % 4 = 0 then concat('changed ', text)
  when side = 'release' and doc_id % 7 = 0 then null else text end as content
from documents cross join (select 'before' as side union all select 'after' as side union all select 'release' as side) sides
where side <> 'before' or doc_id % 10 <> 6""",
}


def with_adapters(sql: str, *names: str) -> str:
    """Prefix a query with the named adapters as CTEs."""
    ctes = ",\n".join(f"{n} as ({ADAPTER_SQL[n]})" for n in names)
    return f"with {ctes}\n{sql}"
