import random

import pytest

from commitlens.llm import components, ngram_join, shingles
from tests.llm import brute


def run(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(df, **kw).collect()}


def test_contract_on_given_documents(documents, doc_rows):
    assert run(documents) == brute.jaccard(doc_rows)


def test_contract_on_edge_texts(edge, edge_docs):
    assert run(edge) == brute.jaccard(edge_docs)


@pytest.mark.parametrize("k, pct, seed", [(4, 85, 1), (5, 80, 2), (1, 85, 3)])
def test_near_copies_at_the_threshold(spark, k, pct, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 40, 150]))]
        for _ in range(rnd.choice([1, 4, 40])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 20))):
                i = rnd.randrange(len(w))
                w[i:i + rnd.choice([0, 1, 1])] = [rnd.choice(vocabulary)]
            rows.append((len(rows) * 7 % 1000, "a common line of many documents " + " ".join(w) if g % 3 else " ".join(w)))
    rows += [(2000 + i, " ".join(f"u{i}x{j}" for j in range(50))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df, k=k, pct=pct) == brute.jaccard(rows, pct, k)


def test_odd_tables(odd):
    out = ngram_join.link_documents(odd).collect()
    assert len(out) == odd.count()
    assert all(r.component_id is None for r in out if r.doc_id is None and not r.n_shingles)
    assert ngram_join.link_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2000, 20_000])
def test_repeated_rows_in_several_chunks(spark, monkeypatch, size):
    """Rows that all stand twice, in the same and in other chunks, link as they do when they stand once."""
    small = ngram_join.chunks
    monkeypatch.setattr(ngram_join, "chunks", lambda batches, text: small(batches, text, size))
    rnd = random.Random(7)
    rows = []
    for _ in range(60):
        base = [f"w{rnd.randrange(300)}" for _ in range(60)]
        for _ in range(rnd.choice([1, 2, 5])):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(300)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    twice = df.union(df)
    assert ngram_join.link_documents(twice).count() == 2 * len(rows)
    assert run(twice) == brute.jaccard(rows)


def test_blocks_hold_each_set_once_under_keys_of_their_own(spark, monkeypatch):
    small, seen, inner = ngram_join.chunks, [], ngram_join.row_chunks
    monkeypatch.setattr(ngram_join, "chunks", lambda batches, text: small(batches, text, 1000))
    monkeypatch.setattr(ngram_join, "row_chunks", lambda texts, k: seen.append(inner(texts, k)) or seen[-1])
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(40)) + f" end{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df.union(df).union(df)) == brute.jaccard(rows)
    got = seen[0].collect()
    sids = [x for r in got for x in r.sid]
    assert len(sids) == len(set(sids)) == len(rows) and len({r.chunk for r in got}) == len(got) > 1


def test_long_words_and_blocks(monkeypatch):
    texts = ["a bb " * 50 + "x" * 5000 + " cc", None, "", "x" * 5000, "a b c d e"]
    want, n = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "BLOCK", 64)
    got, m = shingles.word_hashes(texts)
    assert (want == got).all() and (n == m).all() and n.tolist() == [102, 0, 0, 1, 5]


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    root = brute.components(400, links)
    assert got == {x: root[x] for a, b in links if a != b for x in (a, b)}
    assert components.connected_components(df.limit(0)).count() == 0
