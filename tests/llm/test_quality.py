from commitlens.llm.quality import quality_rules
from tests.llm import brute

COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def run(df):
    return {r.doc_id: tuple(r[c] for c in COLS) for r in quality_rules(df).collect()}


def test_base_on_given_documents(documents, doc_rows):
    assert run(documents) == {d: brute.quality_base(t) for d, t in doc_rows}


def test_base_on_edge_texts(edge, edge_docs):
    assert run(edge) == {d: brute.quality_base(t) for d, t in edge_docs}


def boiler(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(25))
    rows = [(i, "Menu of the site here\n" + own(i), "a") for i in range(30)]
    rows += [(100 + i, "Menu of the site here\n" + own(100 + i), "b") for i in range(10)]
    rows += [(200 + i, "\n".join(["Menu of the site here"] * 12) + "\nfew own words " + str(i), "a") for i in range(3)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_frequent_lines_deplete(spark):
    rows, df = boiler(spark)
    out = {r.doc_id: r for r in quality_rules(df).collect()}
    line = len("Menuofthesitehere")
    assert out[0].removed_chars == 0 and out[1].removed_chars == line and out[100].removed_chars == 0
    assert all(out[i].kept for i in (*range(30), *range(100, 110)))
    assert not any(out[200 + i].kept for i in range(3))


def test_cleaned_texts(spark):
    rows, df = boiler(spark)
    out = {r.doc_id: r.text for r in quality_rules(df, clean_texts=True).collect()}
    assert set(out) == {*range(30), *range(100, 110)}
    want = {d: t for d, t, _ in rows}
    assert out[0] == want[0] and out[100] == want[100]
    assert out[7] == want[7].split("\n")[1]


def test_depleted_only(spark):
    rows = [(i, "same line of a few words all over again and more\n" * 2 + "x", "a") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(df).collect()}
    assert out[3][1] is False


def test_odd_tables(odd):
    out = quality_rules(odd).collect()
    assert len(out) == odd.count()
    kept = quality_rules(odd, clean_texts=True)
    assert set(kept.columns) == set(odd.columns)
    assert kept.count() == sum(r.kept for r in out)
    assert quality_rules(odd.limit(0)).count() == 0


def test_limit_counts_documents_exactly(spark):
    """On hosts of over 1,000 documents a line in exactly 2 % of them stays, one in a document more goes."""
    sizes = {f"host{k}": 1000 + 650 * k for k in range(12)}
    rows, at, over = [], 0, {}
    for host, n in sizes.items():
        limit = n // 50
        for i in range(n):
            lines = [f"own{at} " + "text " * 3]
            lines += ["line at the limit"] if i < limit else []
            lines += ["line above the limit"] if i <= limit else []
            over[at] = 0 < i <= limit
            rows.append((at, "\n".join(lines), host))
            at += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r.removed_chars for r in quality_rules(df).collect()}
    assert got == {d: len("lineabovethelimit") if gone else 0 for d, gone in over.items()}


def test_native_plan(documents):
    plan = quality_rules(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))
