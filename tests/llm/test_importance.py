import random
import zlib

import numpy as np
import pytest

from commitlens.llm import importance
from tests.llm import brute


def run(docs, target, **kw):
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in importance.resample(docs, target, **kw).collect()}


def test_position_table_equals_crc32():
    rnd = random.Random(1)
    sizes = [1, 2, 3, 63, 64, 65, 127, 128, 129, 1000, 70_000]
    data = bytes(rnd.randrange(256) for _ in range(200_000))
    spans = [(rnd.randrange(len(data) - n), n) for n in sizes for _ in range(5)] + [(0, len(data))]
    got = importance.span_crcs(np.frombuffer(data, np.uint8), np.array([a for a, _ in spans]), np.array([n for _, n in spans]))
    assert got.tolist() == [zlib.crc32(data[a:a + n]) for a, n in spans]


@pytest.mark.parametrize("orders, piece", [(1, 1), (1, 1 << 18), (2, 50), (3, 1 << 18)])
def test_features_of_pieces(monkeypatch, orders, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    rnd = random.Random(orders)
    words = [bytes(rnd.choice(b"abcdefgh\xc3\xa4") for _ in range(rnd.choice([1, 3, 9, 200]))) for _ in range(300)]
    want = sorted(zlib.crc32(b" ".join(words[i:i + n])) for n in range(1, orders + 1) for i in range(len(words) - n + 1))
    assert sorted(importance.feature_crcs(words, orders).tolist()) == want


@pytest.mark.parametrize("orders", [1, 2])
def test_contract_on_given_documents(spark, sf, documents, doc_rows, orders):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert run(documents, items, orders=orders) == brute.importance(doc_rows, [r.text for r in items.collect()], orders)


def test_edge_texts_ties_and_shares(spark, edge, edge_docs):
    more = [(100 + i, "the same twenty words " * 5) for i in range(40)]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(6)
    target = spark.createDataFrame([("a shared line of text",), (None,), ("",)], "text string")
    for share in (0, 37, 100):
        assert run(docs, target, share_pct=share) == brute.importance(edge_docs + more, ["a shared line of text", None, ""], share=share)


def test_odd_tables(spark, odd):
    target = spark.createDataFrame([(None, 1)], "text string, doc_id int")
    out = importance.resample(odd, target, share_pct=50, min_words=1).collect()
    rows = odd.select("doc_id", "text").collect()
    assert len(out) == len(rows) and all(r.score is None and r["rank"] is None for r in out if r.doc_id is None)
    able = [r for r in rows if r.doc_id is not None and brute.alnum(r.text)]
    ranked = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(able) // 2 + 1))
    assert [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in ranked)
    assert importance.resample(odd.limit(0), target).count() == 0
    assert {r.weight for r in importance.resample(odd.where("doc_id = 15"), target.limit(0)).collect()} == brute_weight(odd)


def brute_weight(odd):
    rows = [(r.doc_id, r.text) for r in odd.where("doc_id = 15").select("doc_id", "text").collect()]
    return {brute.importance(rows, [])[15][1]}
