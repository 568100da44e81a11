import collections
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from commitlens.llm import packing


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def check(rows, docs, tok, limit=1024):
    want = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in docs}
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 1 <= r.length <= limit
            assert k == 0 or r.length == limit
            assert zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= limit
    return len(bins)


def test_contract_on_given_documents(documents, doc_rows, tok):
    rows = packing.pack(documents).collect()
    n = check(rows, doc_rows, tok)
    assert n <= 1.01 * -(-sum(r.length for r in rows) // 1024) + 1


def test_contract_on_edge_texts(edge, edge_docs, tok):
    check(packing.pack(edge).collect(), edge_docs, tok)
    check(packing.pack(edge, shard_pieces=5).collect(), edge_docs, tok)


def test_same_result_however_partitioned(edge):
    a, b = (sorted(map(tuple, packing.pack(edge.repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_odd_tables(odd):
    rows = packing.pack(odd).collect()
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert packing.pack(odd.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab 'sÉß\t\n\r.,0٣\x85\xa0\x1c <|endoftext|>", max_size=40)))
def test_fast_encoder_gives_the_same_ids(text):
    enc = test_fast_encoder_gives_the_same_ids.__dict__.setdefault("enc", packing.Encoder(*packing.default_vocabulary()))
    assert enc(text).tolist() == enc.exact.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 30), max_size=60))
def test_placement_is_the_least_sum_of_squares(lengths):
    limit = 30
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), limit)
    level = {}
    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
        assert level.get(b, 0) == o and o + s <= limit
        score = lambda lv: sum(c * c for c in collections.Counter(limit - x for x in lv.values() if x < limit).values())
        options = [score({**level, k: v + s}) for k, v in level.items() if v + s <= limit] or [score({**level, -1: s})]
        level[b] = o + s
        assert score(level) == min(options)


def test_long_runs_do_not_stop_the_encoder():
    """Runs that the faster encoder can not take go through the tokenizer file."""
    enc = packing.Encoder(*packing.default_vocabulary())
    for c in (" ", "\n", "a", "1", ".", "\t ", "ab "):
        for n in (4999, 5001, 300_000):
            text = "x" + c * n + "y"
            ids = enc(text)
            assert enc.exact.decode(ids.tolist(), skip_special_tokens=False) == text
            if n < 10_000:
                assert ids.tolist() == enc.exact.encode(text, add_special_tokens=False).ids
    assert len(enc("x" + " " * 1_000_000)) > 0
