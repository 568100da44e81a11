import pytest
from pyspark.sql import functions as F

from commitlens.llm import secrets
from tests.llm import brute

NAMES = tuple(r.name for r in secrets.BASE)


def run(df):
    out = secrets.scan_versions(df).withColumn("base", F.sha2(secrets.span_list(F.col("found"), NAMES), 256))
    got = {}
    for r in out.collect():
        n = [sum(f.rule == k for f in r.found) for k in NAMES]
        got[r.doc_id] = (*n, r.base)
    return got


def test_base_on_given_documents(documents, doc_rows):
    assert run(documents) == {d: brute.secret_spans(t) for d, t in doc_rows}


def test_base_on_edge_texts(edge, edge_docs):
    assert run(edge) == {d: brute.secret_spans(t) for d, t in edge_docs}


def test_more_rules(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20 + " https://u:pw@host/x eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh1 xoxb-123456789012"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secrets.scan_versions(df).first().found
    assert {"private_key", "github", "url_login", "jwt", "slack"} <= {f.rule for f in found}
    assert text[found[0].start:found[0].end] == "-----BEGIN RSA PRIVATE KEY-----"


@pytest.fixture()
def ledger(spark, edge):
    rows = secrets.update_ledger(edge, rules=secrets.BASE).collect()
    return spark.createDataFrame(rows, secrets.LEDGER_SCHEMA)


def test_increment_scans_only_unseen_pairs(spark, edge, ledger):
    n_blobs = edge.select(secrets.blob_of(F.col("text"))).distinct().count()
    assert ledger.count() == n_blobs * len(secrets.BASE)
    assert secrets.update_ledger(edge, ledger, secrets.BASE).count() == 0
    more = edge.unionByName(spark.createDataFrame([(99, "token = 'zzzzzzzzz'", None)], edge.schema))
    new = secrets.update_ledger(more, ledger, secrets.BASE)
    assert new.count() == len(secrets.BASE)
    newer = (secrets.Rule("assign", 2, secrets.BASE[0].pattern, 2, 8), *secrets.BASE[1:])
    again = secrets.update_ledger(edge, ledger, newer)
    assert [(r.rule, r.version) for r in again.select("rule", "version").distinct().collect()] == [("assign", 2)]
    assert again.count() == n_blobs


def test_incremental_equals_whole(spark, edge, ledger):
    more = edge.unionByName(spark.createDataFrame([(99, "token = 'zzzzzzzzz'", None), (98, 'password="hunter22"', None)], edge.schema))
    key = lambda df: sorted((r.doc_id, str(r.found)) for r in df.collect())
    assert key(secrets.scan_versions(more, ledger)) == key(secrets.scan_versions(more))


def test_odd_tables(odd):
    assert secrets.scan_versions(odd).count() == odd.count()
    assert secrets.scan_versions(odd.limit(0)).count() == 0


def test_native_plan(documents):
    plan = secrets.scan_versions(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_long_texts_are_linear(spark):
    import time

    rows = [(1, "a." * 200_000), (2, "a." * 100_000 + "://u:p@h"), (3, "http" * 50_000), (4, "x " * 100_000 + "ftp://user:pass@host")]
    t = time.time()
    got = {r.doc_id: [s["rule"] for s in r.found] for r in secrets.scan_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[3] == [] and got[4] == ["url_login"] and time.time() - t < 60


def test_kept_ledger_over_increments(spark, edge):
    """A part under the base rules, all under all rules, all under a newer rule: the same findings as one whole scan."""
    newer = tuple(secrets.Rule(r.name, r.version + (r.name == "hex"), r.pattern, r.group, r.least) for r in secrets.RULES)
    part = edge.where("doc_id % 2 = 0")
    key = lambda df: sorted((str(r.doc_id), str(r.found)) for r in df.collect())
    assert key(secrets.scan_increments([(part, secrets.BASE), (edge, secrets.RULES), (edge, newer)])) == key(secrets.scan_versions(edge))
    assert key(secrets.scan_increments([(edge.limit(0), secrets.BASE), (edge, secrets.RULES)])) == key(secrets.scan_versions(edge))
