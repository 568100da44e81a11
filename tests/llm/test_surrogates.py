import re

import pytest
import regex

from commitlens.llm import surrogates as S

JOIN = regex.compile(S.PATTERN.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))


def run(spark, rows, secret="k"):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in S.replace_entities(df, secret).collect()}


@pytest.fixture(scope="module")
def given(spark, documents):
    return {r.doc_id: r for r in S.replace_entities(documents.select("doc_id", "text"), "k").collect()}


def pairs(before, after):
    """(mention, surrogate) pairs; also proves that nothing but mentions changed."""
    at, out = 0, []
    for m in JOIN.finditer(before):
        gap = before[at:m.start()]
        assert after.startswith(gap)
        after, at = after[len(gap):], m.end()
        n = len(m[0])
        rest = JOIN.match(after, 0) if not re.match(r"[\d.]+$", m[0]) else re.match(r"[\d.]+", after)
        new = rest[0] if rest else after[:n]
        out.append((m[0], new))
        after = after[len(new):]
    assert after == before[at:]
    return out


def test_given_documents(given, doc_rows):
    mapping, n = {}, 0
    for d, t in doc_rows:
        for a, b in pairs(t, given[d].text):
            n += 1
            assert mapping.setdefault(a, b) == b          # coreference
            assert a != b
        assert sum(e.n for e in given[d].entities) == len(JOIN.findall(t))
    assert n > 90
    assert len(set(mapping.values())) == len(mapping)     # distinctness
    assert not set(mapping) & set(mapping.values())
    planted = r"\d{16}|[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|[0-9a-f]{40}"
    found = {m for _, t in doc_rows for m in re.findall(planted, t)}
    assert len(found) > 60
    rest = "\n".join(r.text for r in given.values())
    assert not [m for m in found if m in rest]


def test_types_and_formats(spark):
    text = ("Bob.Smith7@Mail.example.com +1 (743) 555-3824, 743-555-3824; 4111 1111 1111 1111 4111111111111111 1234567812345678 10.1.2.3 8.8.8.8 "
            "Frau Anna Schmidt, MR. JOHN SCHMIDT, Mr Schmidt, г-жа Анна Иванова; GB29 NWBK 6016 1331 9268 19; 078-05-1120")
    out = run(spark, [(1, text), (2, "to BOB.SMITH7@MAIL.EXAMPLE.COM")])
    m = re.match(r"([a-z]{3}\.[a-z]{5}\d@[a-z]{4}\.[a-z]{7}\.com) \+1 \((\d{3})\) (\d{3})-(\d{4}), (\d{3}-\d{3}-\d{4}); (\d{4} \d{4} \d{4} \d{4}) (\d{16}) (\d{16}) (10(?:\.\d+){3}) (\d+(?:\.\d+){3}) "
                 r"Frau (\w+) (\w+), MR\. (\w+) (\w+), Mr (\w+), г-жа (\w+) (\w+); (GB\d{2} [A-Z]{4} \d{4} \d{4} \d{4} \d{2}); (\d{3}-\d{2}-\d{4})$", out[1])
    assert m, out[1]
    assert "-".join(m.group(2, 3, 4)) == m[5] and m[6].replace(" ", "") == m[7]
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    assert luhn(m[7]) and m[7] != "4111111111111111" and m[8] != "1234567812345678"
    assert not m[10].startswith(("10.", "127.")) and m[10] != "8.8.8.8"
    assert m[11].endswith(tuple(S.ENDINGS["latin"]["f"].split())) and m[13].isupper() and m[13].lower().endswith(tuple(S.ENDINGS["latin"]["m"].split()))
    assert m[12] == m[15] and m[14] == m[12].upper() and re.match(r"[А-я]+$", m[16] + m[17])
    assert out[2] == "to " + m[1].upper()


def test_keyed(spark):
    row = [(1, "call 743-555-3824")]
    assert run(spark, row) == run(spark, row) != run(spark, row, "other")


def test_collisions_are_drawn_again(spark):
    rows = [(i, f"a{c}@b.cc") for i, c in enumerate("abcdefghij0123456789")]
    out = run(spark, rows)
    assert len(set(out.values())) == len(rows) and not set(out.values()) & {t for _, t in rows}


def test_odd_tables(spark, odd):
    from pyspark.sql import functions as F
    more = odd.unionByName(odd.limit(2).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("ip 8.8.8.8, 8.8.4.4 and 8.8.8.8")}))
    more = more.withColumn("entities", F.lit(1))
    out = S.replace_entities(more, "k")
    assert set(out.columns) == set(more.columns)
    rows = out.collect()
    assert len(rows) == more.count()
    new = [r for r in rows if r.doc_id is None and (r.text or "").startswith("ip")]
    assert len(new) == 2 and new[0].text == new[1].text and "8.8" not in new[0].text
    assert S.replace_entities(more.limit(0), "k").count() == 0


def test_long_text_is_linear(spark):
    out = run(spark, [(1, "a" * 2_000_000), (2, "x 8.8.8.8 " * 50_000)])
    assert out[1] == "a" * 2_000_000 and "8.8.8.8" not in out[2] and out[2].count("x ") == 50_000


def test_email_labels_need_no_stack(spark):
    """Thousands of labels; trailing dots and digits after the domain as before."""
    rows = [(1, "x@b" + ".b" * 2000 + ".com"), (2, "to a.b@mail.example.com."), (3, "a@foo.com.123 and b@foo.com2"), (4, "c@x..com d@-a.de"), (5, "x@b" + ".b" * 2000)]
    out = run(spark, rows)
    assert all("example.com" not in out[2] and out[2].startswith("to ") and out[2].endswith(".") for _ in [0])
    assert "a@foo.com" not in out[3] and "b@foo.com" not in out[3] and out[3].endswith("2") and ".123 and " in out[3]
    assert out[4].startswith("c@x..com ") and "d@-a.de" not in out[4] and out[1] != rows[0][1] and out[5] == rows[4][1]


def test_bare_names_keep_their_surrogate(spark):
    """The same person with a title, without, as possessive, in capitals; other documents and ordinary words stay."""
    rows = [(1, "Mr John Smith called. Smith said that John was late; JOHN's car, Smith-like. Mary Smith stayed."),
            (2, "Smith and John came."), (3, "I Miss The bus. The end of the day."), (4, "Dr Anna Jones came, then Mrs Anna Jones. Anna left."),
            (5, "Call 5551234567 or 5551234567, tel. 5551234567."), (6, None), (None, "Prof Ada Byron. Byron's"), (7, "Mr Smith's dog. Smith")]
    out = {}
    for r in S.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect():
        out[r.doc_id] = (r.text, {e.kind: e.n for e in r.entities})
    m = re.match(r"Mr (\w+) (\w+) called\. (\w+) said that (\w+) was late; (\w+)'s car, Smith-like\. Mary (\w+) stayed\.$", out[1][0])
    assert m, out[1]
    assert m[2] == m[3] == m[6] != "Smith" and m[1] == m[4] and m[5] == m[1].upper() and m[1] != "John"
    assert out[1][1] == {"name": 1, "bare_name": 4}
    assert out[2][0] == rows[1][1] and out[3][0].endswith(" bus. The end of the day.")
    m4 = re.match(r"Dr (\w+) (\w+) came, then Mrs (\w+) (\w+)\. (\w+) left\.$", out[4][0])
    assert m4 and m4[1] == m4[3] == m4[5] != "Anna" and m4[2] == m4[4]
    assert m4[1].endswith(tuple(S.ENDINGS["latin"]["f"].split()))
    m5 = re.match(r"Call (\d{10}) or 5551234567, tel\. (\d{10})\.$", out[5][0])
    assert m5 and m5[1] == m5[2] != "5551234567"
    assert out[6][0] is None
    mn = re.match(r"Prof (\w+) (\w+)\. (\w+)'s$", out[None][0])
    assert mn and mn[2] == mn[3] != "Byron"
    assert re.match(r"Mr (\w+)'s dog\. (\w+)$", out[7][0]).groups() == (m[2], m[2])


def test_account_check_digits(spark):
    out = run(spark, [(1, "GB29 NWBK 6016 1331 9268 19"), (2, "DE89370400440532013000"), (3, "GB00 NWBK 6016 1331 9268 19")])
    def remainder(s):
        s = s.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    assert remainder(out[1]) == 1 and remainder(out[2]) == 1
    assert out[1][:2] == "GB" and out[2][:2] == "DE" and len({*out.values()}) == 3


def test_names_grow(spark):
    """More names than the short forms can give."""
    rows = [(i, f"Mr Ab{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}") for i in range(30_000)]
    out = run(spark, rows)
    assert len(set(out.values())) == 30_000 and not set(out.values()) & {t for _, t in rows}
