import random

import numpy as np
import pytest

from commitlens.llm import ranked_search as search
from tests.llm import brute


def run(docs, items, **kw):
    return sorted(tuple(r) for r in search.rank_documents(docs, items, **kw).collect())


def test_contract_on_given_documents(spark, sf, documents, doc_rows):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert run(documents, items) == sorted(brute.ranked(doc_rows, [(r.item_id, r.text) for r in items.collect()]))


@pytest.mark.parametrize("block, cells", [(512, 1 << 22), (3, 100)])
def test_blocks_ties_and_copies(spark, monkeypatch, block, cells):
    monkeypatch.setattr(search, "ITEM_BLOCK", block)
    monkeypatch.setattr(search, "CELLS", cells)
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "ÄÖ", "été"]
    docs = [(i, " ".join(rnd.choice(vocabulary[: 5 + i % 58]) for _ in range(rnd.randint(1, 40)))) for i in range(200)]
    docs += [(1000 + i, docs[0][1]) for i in range(80)]                     # more ties than places
    items = [(i, " ".join(rnd.sample(vocabulary, rnd.randint(1, 30)))) for i in range(20)] + [(90, docs[0][1]), (91, "nowhere"), (92, ""), (93, None)]
    got = run(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert got == sorted(brute.ranked(docs, items))


def test_sharing_graph_equals_plain_sums():
    """Every item's sets hold exactly its terms, and shared sets save additions."""
    rnd = random.Random(8)
    core = list(range(100, 112))
    items = [set(rnd.sample(range(60), rnd.randint(0, 25))) | set(core if i % 2 else core[:6]) for i in range(40)]
    rows = [(i, t) for i, m in enumerate(items) for t in m]
    g = search.share(np.array([i for i, _ in rows]), np.array([t for _, t in rows]), np.ones(len(rows), np.int64), len(items))
    made = g.n_sets - sum(len(a) for a, _ in g.rounds)
    content = [set(g.terms[g.leaf == s].tolist()) for s in range(made)]
    for a, b in g.rounds:
        for x, y in zip(a, b):
            assert not content[x] & content[y]
            content.append(content[x] | content[y])
    for m, sets in zip(items, g.items):
        parts = [content[s] for s in sets]
        assert set().union(*parts) == m and sum(map(len, parts)) == len(m)
    assert sum(len(a) for a, _ in g.rounds) + sum(map(len, g.items)) < 0.6 * sum(map(len, items))


def test_edge_texts_and_odd_tables(spark, edge, edge_docs, odd):
    items = [(1, "A shared line of text"), (1, "one two three"), (None, "line"), (2, "A shared line of text"), (2, "A shared line of text"), (3, "é😀 ünïcode"), (4, "a" * 100_000)]
    df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "2 as score")
    key = lambda rows: sorted(rows, key=str)
    assert key(run_rows(edge, df)) == key(brute.ranked(edge_docs, items))
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert key(run_rows(odd, df)) == key(brute.ranked(rows, items))
    assert run(odd.limit(0), df) == run(odd, df.limit(0)) == []


def run_rows(docs, items):
    return [tuple(r) for r in search.rank_documents(docs, items).collect()]
