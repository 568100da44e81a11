from pyspark.sql import functions as F

from commitlens.llm.line_dedup import dedup_lines
from tests.llm import brute


def run(df):
    out = dedup_lines(df.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("s"))
    return {r.doc_id: (r.n_lines, r.n_dropped, r.s) for r in out.collect()}


def test_contract_on_given_documents(documents, doc_rows):
    assert run(documents) == brute.line_dedup(doc_rows)


def test_contract_on_edge_texts(edge, edge_docs):
    assert run(edge) == brute.line_dedup(edge_docs)


def test_odd_tables(odd):
    out = dedup_lines(odd)
    assert set(odd.columns) == set(out.columns)
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(r.n_dropped == 0 and r.n_lines == 1 for r in rows if r.doc_id is None)
    assert sorted(r.text for r in rows if r.doc_id == 5) == ["", "", "other text of five"]


def test_empty_table(odd):
    assert dedup_lines(odd.limit(0)).count() == 0


def test_limit_of_two_documents(spark):
    df = spark.createDataFrame([(1, "common line here"), (2, "common line here"), (3, "another line x"), (4, "another line x"), (5, "another line x")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in dedup_lines(df, max_docs=2).collect()}
    assert kept == {1: "common line here", 2: "common line here", 3: "another line x", 4: "", 5: ""}
