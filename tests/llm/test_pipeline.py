import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from commitlens.llm import quality
from tests.llm import brute
from tests.llm.test_decontam import plain


def quality_plain(rows):
    """(doc_id, text, source) rows that stay, with cleaned texts."""
    docs, hosts = collections.defaultdict(set), collections.Counter()
    for d, t, s in rows:
        hosts[s] += 1
        for x in (t or "").split("\n"):
            if brute.line_key(x):
                docs[s, brute.line_key(x)].add(d)
    often = {k: min(v) for k, v in docs.items() if len(v) > quality.MIN_DOCS and len(v) > quality.HOST_SHARE * hosts[k[0]]}
    chars = lambda x: sum(map(len, brute.WORD.findall(x)))
    out = []
    for d, t, s in rows:
        base = brute.quality_base(t)
        gone = [often.get((s, brute.line_key(x)), d) != d for x in (t or "").split("\n")]
        removed = sum(chars(x) for x, g in zip((t or "").split("\n"), gone) if g)
        if not base[-1] and removed <= (1 - quality.MIN_LEFT) * base[1]:
            out.append((d, "\n".join(x for x, g in zip(t.split("\n"), gone) if not g) if any(gone) else t, s))
    return out


def lines_plain(rows):
    where = collections.defaultdict(set)
    for d, t, _ in rows:
        for x in t.split("\n"):
            if len(brute.line_key(x)) >= 10:
                where[brute.line_key(x)].add(d)
    out = []
    for d, t, s in rows:
        new = "\n".join(x for x in t.split("\n") if len(where.get(brute.line_key(x), ())) < 2 or min(where[brute.line_key(x)]) == d)
        if brute.WORD.search(new):
            out.append((d, new, s))
    return out


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in cp.STAGES:
        docs = cp.materialise(f(spark, docs, sf), name)
        out.append(docs)
    return out


def rows_of(df):
    return sorted((r.doc_id, r.text, r.source) for r in df.collect())


def test_stages_follow_the_plain_version(steps, documents, spark, sf):
    rows = rows_of(documents)
    want = quality_plain(rows)
    assert rows_of(steps[0]) == sorted(want) and 0 < len(want) < len(rows)
    want = lines_plain(want)
    assert rows_of(steps[1]) == sorted(want)
    root = brute.jaccard([(d, t) for d, t, _ in want], cp.SIMILARITY_PCT, cp.SHINGLE_WORDS)
    want = [r for r in want if root[r[0]][1] == r[0]]
    assert rows_of(steps[2]) == sorted(want)
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = lambda t: {tuple(w[i:i + 4]) for w in [t.split()] for i in range(len(w) - 3)}
    items = [(x, grams(x)) for x in items]
    whole = {r[0] for r in want if any(x in plain(r[1]) for x, _ in items)}
    part = {r[0] for r in want if any(len(g & grams(plain(r[1]))) >= 0.4 * len(g) for _, g in items)}   # line dedup has cut some
    kept = rows_of(steps[3])
    assert set(kept) <= set(want)
    assert whole <= {r[0] for r in want} - {r[0] for r in kept} <= part
    packed = steps[4].collect()
    assert {r.doc_id for r in packed} == {d for d, _, _ in kept}


def test_columns_and_lengths(steps, documents):
    for df in steps[:-1]:
        assert df.dtypes == documents.dtypes
        assert df.where(F.length("text") != F.col("n_chars")).count() == 0


def test_run_is_the_stages(spark, sf, steps):
    assert entry.queries()["pipeline"] is cp.run
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "packing"]


def test_stages_on_odd_and_empty_tables(spark, odd, sf):
    docs = odd.withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(0).cast("long"))
    for df in (docs, docs.limit(0)):
        for _, f in cp.STAGES:
            df = f(spark, df, sf)
            df.count()
