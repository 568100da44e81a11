import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from commitlens.llm import decontam


def plain(t):
    return " " + " ".join((t or "").encode().lower().translate(decontam.FOLD).decode().split()) + " "


@pytest.fixture(scope="module")
def truth(doc_rows, spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    docs = [(d, plain(t)) for d, t in doc_rows]
    return bench, {(d, i) for d, t in docs for i, x in items if x in t}


def test_all_copies_and_nothing_else(documents, truth):
    bench, want = truth
    found = decontam.find_leaks(documents, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 20
    assert all(r.lcs == 1.0 for r in found)


def test_search_recall_against_brute_force(documents, truth):
    """Of the pairs whose passage cosine in the full TF-IDF space is high, the search finds at least 0.9."""
    bench, want = truth
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(documents, bench, check=False).collect()}
    idf = decontam.idf_weights(documents, "text")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect() if r.doc_id % 5 == 0 or (r.doc_id in {d for d, _ in want})]
    items = [(r.item_id, r.text) for r in bench.collect()]
    vec = lambda words: np.bincount(decontam.features(words), weights=idf[decontam.features(words)], minlength=decontam.FEATURES)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    Y = np.array([unit(vec(decontam.word_hashes([t], decontam.FOLD)[0])) for _, t in items])
    high = set()
    for d, t in rows:
        w = decontam.word_hashes([t], decontam.FOLD)[0]
        for s in range(0, max(1, len(w) - decontam.STEP), decontam.STEP):
            c = Y @ unit(vec(w[s:s + decontam.WINDOW]))
            high |= {(d, items[j][0]) for j in np.flatnonzero(c >= 0.6)}
    assert len(high) >= 20 and len(high & found) >= 0.9 * len(high)


def test_paraphrases_and_answers(spark, doc_rows):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(4))) for i in range(8)]
    rows = [(10_000 + i, t) for i, (_, t) in enumerate(doc_rows[:150])]

    def changed(text, share, last):
        w = text.split()
        for k in range(len(w) - (4 if last else 0)):
            if rnd.random() < share:
                w[k] = word()
        return " ".join(w)

    pad = lambda n: " ".join(word() for _ in range(n))
    for i, t in items[:4]:
        rows.append((i, pad(77) + "\n" + changed(t, 0.3, True) + " " + pad(50)))       # paraphrase with its answer
        rows.append((100 + i, pad(40) + " " + changed(t, 0.1, True).upper() + " " + pad(200)))   # near copy
        rows.append((200 + i, pad(40) + " " + " ".join(t.split()[:20]) + " " + pad(60)))         # weak match without the answer
        rows.append((300 + i, " ".join(x + " " + pad(6) for x in t.split())))                    # scattered words
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(i, i) for i in range(4)} | {(100 + i, i) for i in range(4)}


def test_long_items_blocks_and_answer_column(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 2)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    long = " ".join(word() for _ in range(300))
    items = [("a", long, None), ("b", " ".join(word() for _ in range(20)), "forty two"), ("c", " ".join(word() for _ in range(20)), None), ("d", "", ""), (None, "x y", None), ("e", None, "x")]
    docs = spark.createDataFrame([(1, "intro " + " ".join(long.split()[130:260])), (2, items[1][1]), (3, items[2][1]), (4, None), (5, ""), (None, items[1][1]), (2, items[1][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "id string, question string, solution string")
    out = decontam.find_leaks(docs, bench, item_col="id", item_text="question", answer_col="solution").collect()
    assert {(r.doc_id, r.id) for r in out} == {(1, "a"), (2, "b"), (3, "c"), (None, "b")} and len(out) == 4


def test_odd_tables(spark, odd, truth):
    bench, _ = truth
    assert decontam.find_leaks(odd, bench).count() == 0
    assert decontam.find_leaks(odd.limit(0), bench).count() == 0
    assert decontam.find_leaks(odd, bench.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontam.common_subsequence(a, b) == table[-1][-1]


def test_short_items_in_long_documents(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(5)]
    rows = [(i, " ".join(word() for _ in range(40 + 9 * i)) + " " + t + " " + " ".join(word() for _ in range(300))) for i, t in items]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()} == {(i, i) for i in range(5)}


@pytest.mark.parametrize("n", [60, 64, 75, 95])
def test_excerpts_across_a_cut(spark, n):
    """Verbatim runs of a long item are found wherever they start, without the item's answer."""
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    pad = lambda k: " ".join(word() for _ in range(k))
    items = [(i, pad(200) + ". " + pad(8)) for i in range(4)]
    starts = range(0, 200 - n, 7)
    rows = [(1000 * i + s, pad(30 + s) + " " + " ".join(t.split()[s:s + n]) + " " + pad(90)) for i, t in items for s in starts]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(1000 * i + s, i) for i, _ in items for s in starts}


def test_rest_of_a_cut_and_few_words(spark):
    """One word after a cut, or part of an item of a few words, is no leak."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    pad = lambda k: " ".join(word() for _ in range(k))
    long = pad(65)
    items = [(1, long, None), (2, "zebra quagga okapi gnu", "forty two")]
    rows = [(1, pad(20) + " " + long + " " + pad(20)), (2, long.split()[-1] + " " + pad(10)), (3, pad(40) + " " + long.split()[-1] + " " + pad(10)),
            (4, "zebra quagga okapi gnu is " + pad(6)), (5, "zebra quagga of the okapi gnu forty two " + pad(6)), (6, pad(6) + " Zebra quagga, okapi gnu? Forty two. " + pad(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench, answer_col="answer").collect()}
    assert got == {(1, 1), (6, 2)}


@pytest.mark.parametrize("share", [0.25, 0.35, 0.45])
def test_whole_path_recall_on_swapped_rare_words(documents, truth, share):
    """Items keep their answer; of the other words the rarest are swapped for common ones.  Truth is the plain rule on the planted text."""
    bench, _ = truth
    rnd = random.Random(round(share * 100))
    idf = decontam.idf_weights(documents, "text")
    weight = lambda word: float(idf[decontam.features(decontam.word_hashes([word], decontam.FOLD)[0])][0])
    vocabulary = sorted({x for r in documents.select("text").limit(200).collect() for x in plain(r.text).split()}, key=lambda x: (weight(x), x))
    common = vocabulary[:60]
    rows, items = [], {r.item_id: r.text for r in bench.collect()}
    for i, text in items.items():
        words = plain(text).split()
        last = len(plain([s for s in text.split("\n")[-1].split(". ") if s.strip()][-1]).split())
        body = words[:len(words) - last]
        swap = sorted(range(len(body)), key=lambda k: -weight(body[k]))[:int(share * len(body))]
        for k in swap:
            body[k] = rnd.choice(common)
        pad = lambda: " ".join(rnd.choice(common) for _ in range(40))
        rows.append((1_000_000 + i, " ".join([pad(), *body, *words[len(words) - last:], pad()])))
    planted = documents.sparkSession.createDataFrame(rows, "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(planted)
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    hashes = lambda t: decontam.word_hashes([t], decontam.FOLD)[0].tolist()
    want = set()
    for d, t in rows:
        text = items[d - 1_000_000]
        answer = [s for s in text.split("\n")[-1].split(". ") if s.strip()][-1]
        if decontam.match(decontam.Item(hashes(text), hashes(answer)), hashes(t)) is not None:
            want.add((d, d - 1_000_000))
    assert len(want) >= 0.9 * len(rows) and len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("kind", ["smallint", "date", "decimal(5,1)", "string"])
def test_any_type_of_item_id(spark, kind):
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, "so " + word + " it is")], "doc_id long, text string")
    bench = spark.createDataFrame([("2024-01-02" if kind == "date" else "7", word)], "item_id string, text string").selectExpr(f"cast(item_id as {kind}) item_id", "text")
    out = decontam.find_leaks(docs, bench)
    assert out.schema["item_id"].dataType.simpleString() == kind and out.count() == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=150), min_size=1, max_size=5), st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=64), min_size=1, max_size=4))
def test_word_bound_loses_no_match(texts, items):
    hashed = lambda ws: np.array(ws, np.uint64) << np.uint64(64 - decontam.FEATURES.bit_length() + 1)
    n = np.array([len(t) for t in texts])
    w = hashed([x for t in texts for x in t])
    _, owner, first = decontam.windows(w, n, np.zeros((decontam.FEATURES + 1, 1), np.float32))
    if not len(owner):
        return
    bound = decontam.WordBound([decontam.features(hashed(i)) for i in items])
    slot, blocks = bound.slot[decontam.features(w)], -(-n // decontam.STEP)
    block, slot = decontam.block_of(n)[slot >= 0], slot[slot >= 0]
    home = (np.cumsum(blocks) - blocks)[owner] + first // decontam.STEP
    i, j = np.nonzero(np.ones((len(owner), len(items)), bool))
    for a, b, ok in zip(i.tolist(), j.tolist(), bound.may_match(block, slot, home, i, j).tolist()):
        t, s, item = texts[owner[a]], int(first[a]), items[b]
        region = t[max(0, s - len(item) // 2):s + decontam.WINDOW + len(item) // 2]
        assert ok or decontam.common_subsequence(item, region) < decontam.PARAPHRASE_LCS * len(item)


def test_fit_takes_every_passage(spark, monkeypatch):
    """The latent vectors are fitted on all documents and all items, not on a part of them."""
    fitted = {}
    vectors = decontam.singular_vectors

    def counted(rows, idf, rank):
        fitted["rows"] = rows.count()
        return vectors(rows, idf, rank)

    monkeypatch.setattr(decontam, "singular_vectors", counted)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(10))) for i in range(2500)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(word() for _ in range(12))) for i in range(4200)], "item_id long, text string")
    decontam.find_leaks(docs, bench, rank=8)
    assert fitted["rows"] == 2500 + 4200


def test_panel_equals_dense_product(spark, monkeypatch):
    """Both products of the fit against a dense passage matrix, for texts of odd lengths, hot words, nulls and several chunks."""
    monkeypatch.setattr(decontam, "FIT_WORDS", 300)
    rnd = random.Random(10)
    texts = [" ".join(rnd.choice(["the", "of"] + [f"w{k}" for k in range(400)] * (k % 3 > 0)) for k in range(n)) for n in (1, 31, 32, 33, 64, 65, 96, 700, 2, 120)] + [None, "", "  "]
    rows = spark.createDataFrame([(t, 1.0 + i % 2) for i, t in enumerate(texts)], "text string, weight double")
    weights = [1.0 + i % 2 for i in range(len(texts))]
    idf = decontam.idf_weights(rows, "text")
    seen = np.zeros(decontam.FEATURES)
    passages = []
    for t, scale in zip(texts, weights):
        f = decontam.features(decontam.word_hashes([t], decontam.FOLD)[0])
        seen[np.unique(f)] += 1
        for s in range(0, max(1, len(f) - decontam.STEP), decontam.STEP):
            part = f[s:s + decontam.WINDOW]
            if len(part):
                passages.append(scale * np.bincount(part, minlength=decontam.FEATURES) * idf / np.sqrt((idf[part] ** 2).sum()))
    assert np.allclose(idf, np.log((1 + len(texts)) / (1 + seen)) + 1, rtol=1e-5)
    a = np.array(passages)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((decontam.FEATURES, 5)))[0].astype(np.float32)
    words = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    both = [decontam.text_features(words.where(f"i % 2 = {k}"), "text").selectExpr("words", f"{1.0 + k}D as weight") for k in range(2)]
    fit = both[0].unionByName(both[1])
    want = a.T @ (a @ q)
    assert np.abs(decontam.panel(fit, q, idf) - want).max() < 4e-3 * np.abs(want).max()
    want = (a @ q).T @ (a @ q)
    assert np.abs(decontam.panel(fit, q, idf, gram=True) - want).max() < 4e-3 * np.abs(want).max()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=200), st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=64), min_size=1, max_size=4), st.integers(0, 150), st.integers(1, 128))
def test_order_bound_loses_no_match(text, items, lo, size):
    hi = min(len(text), lo + size)
    lo = min(lo, hi)
    bound = decontam.OrderBound(items)
    j = np.arange(len(items))
    got = bound.may_match(np.array(text, np.uint64), np.full(len(items), lo), np.full(len(items), hi), j)
    for item, ok in zip(items, got.tolist()):
        best = decontam.common_subsequence(item, text[lo:hi])
        assert ok or (len(item) >= decontam.FEW and best < decontam.PARAPHRASE_LCS * len(item))
    assert decontam.subsequence_lengths(np.array([i + [99] * (64 - len(i)) for i in items], np.uint16), np.array([text[lo:hi] for _ in items], np.uint16).reshape(len(items), -1)).tolist() == [
        decontam.common_subsequence(i, text[lo:hi]) for i in items]
