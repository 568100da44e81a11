import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from commitlens.llm import queries, suffix_dedup
from tests.llm import brute


def run(df, size):
    return {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), brute.sha(bytes(r.kept))) for r in suffix_dedup.remove_repeats(df, size=size).collect()}


def test_contract_on_given_documents(spark, sf, doc_rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_dedup(spark, sf).collect()}
    assert got == brute.repeats(doc_rows)


def test_contract_on_edge_texts(edge, edge_docs):
    short = [(d, t) for d, t in edge_docs if len(t or "") < 10_000]
    assert run(edge.where("length(text) < 10000 or text is null"), 400) == brute.repeats(short)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_parts_of_any_length(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    shared = [word(rnd.randint(380, 460)) for _ in range(8)] + [word(900)]
    rows = []
    for i in range(60):
        parts = [word(rnd.randint(0, 700))]
        for _ in range(rnd.randint(0, 5)):
            s = rnd.choice(shared)
            a = rnd.choice([0, 0, rnd.randint(0, 40)])
            parts += [s[a:len(s) - rnd.choice([0, 0, rnd.randint(0, 40)])], word(rnd.randint(0, 300))]
        rows.append((i, "".join(parts)))
    rows += [(100, "x" * 1000), (101, "x" * 399), (102, "ab" * 300), (103, word(7000)), (104, None), (105, "")]
    rows.append((106, rows[63][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(df, 400) == brute.repeats(rows)


@pytest.mark.parametrize("run_bytes", [2000, 20_000])
def test_repeated_rows_in_several_runs(spark, monkeypatch, run_bytes):
    """Rows that all stand two or three times, in other runs, are one document each; ranges divided by a hash give the same."""
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(suffix_dedup, "MAX_RANGES", 3)
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdef ") for _ in range(n))
    shared = [word(600) for _ in range(6)]
    rows = [(i, word(rnd.randint(300, 900)) + rnd.choice(shared)[rnd.randint(0, 150):] * (i % 3 > 0) + word(200)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    three = df.union(df).union(df).repartition(5)
    out = suffix_dedup.remove_repeats(three, shared=300)
    assert out.count() == 3 * len(rows)
    want, short = brute.repeats(rows), brute.repeats(rows, 300)
    got = {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), brute.sha(bytes(r.kept)), r.n_shared) for r in out.collect()}
    assert got == {d: (*v, short[d][1]) for d, v in want.items()}


def test_odd_tables(odd):
    odd = odd.where("text is null or length(text) < 5000")
    out = suffix_dedup.remove_repeats(odd)
    assert out.count() == odd.count()
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    coded = [suffix_dedup.front_code(r) for r in runs]
    read = [[s for s, _ in suffix_dedup.run_reader(*c)] for c in coded]
    assert read == runs
    at, merged, lcps = [0] * len(runs), [], []
    for r, k in suffix_dedup.merge_runs([suffix_dedup.run_reader(*c) for c in coded]):
        merged.append(runs[r][at[r]])
        lcps.append(k)
        at[r] += 1
    assert merged == sorted(x for r in runs for x in r)
    for a, b, k in zip(merged, merged[1:], lcps[1:]):
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert k == n
