import zlib

import pytest

from commitlens.llm import language, queries


@pytest.fixture(scope="module")
def result(spark, sf):
    return {r.doc_id: r for r in queries.op8_language_id(spark, sf).collect()}


def test_held_out_accuracy(result, documents):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    assert set(result) == set(lang)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in result.items())
    held = [d for d, r in result.items() if r.held_out]
    assert sum(result[d].lang_pred == lang[d] for d in held) >= 0.97 * len(held)
    sure = [d for d in held if not result[d].rejected]
    assert len(sure) > 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in result.values())


def test_undetermined_and_long_texts(spark, documents):
    model = language.fit(["the and of " * 20, "der die das " * 20] * 10, ["en", "de"] * 10)
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "the " * 400_000), (5, "der das"), (None, "the"), (5, "der das"), (6, "😀"), (7, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.lang_pred) for r in language.identify(df, model).collect()]
    assert sorted(out, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (None, "en"), (5, "de"), (6, "und"), (7, out[8][1])], key=str)
    assert out[8][1] in ("en", "de")


def test_blocks_of_a_long_text_change_nothing():
    model = language.fit(["the and of " * 20, "der die das " * 20] * 5, ["en", "de"] * 5)
    text = "the der and die " * 90_000
    import numpy as np
    data = np.frombuffer(language.normal_bytes(text), np.uint8)
    whole = sum(model.table[h].sum(axis=0, dtype=np.float64) for h in language.subwords(data)) / sum(len(h) for h in language.subwords(data))
    assert np.allclose(model.logits(text), whole + model.bias, rtol=1e-4, atol=1e-5)


def test_no_labels_and_odd_tables(spark, odd):
    from pyspark.sql import functions as F
    out, model = language.train_and_identify(odd, F.lit(False))
    assert model.labels == [] and {r.lang_pred for r in out.collect()} == {"und"}
    out, _ = language.train_and_identify(odd, F.lit(True))
    assert out.count() == odd.count()
    assert language.train_and_identify(odd.limit(0), F.lit(True))[0].count() == 0
