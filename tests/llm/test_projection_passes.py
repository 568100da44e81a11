import numpy as np
import pytest

from commitlens.llm import projection_passes as passes
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int"


def run(df, **kw):
    return {r.vec_id: (r.n_links, r.component_id) for r in passes.link_vectors(df, **kw).collect()}


def noisy(rng, base, cosine):
    """A vector at the given cosine from ``base``."""
    e = rng.standard_normal(len(base))
    e -= (e @ base) * base / (base @ base)
    return cosine * base / np.linalg.norm(base) + np.sqrt(1 - cosine ** 2) * e / np.linalg.norm(e)


def f32(v):
    return [float(x) for x in np.asarray(v, np.float32)]


def test_contract_on_given_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert run(df) == brute.linked_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_groups_copies_chains_and_labels(spark):
    """A hot label with a dense group larger than the window, exact copies, loose groups and chains: all links are counted."""
    rng = np.random.default_rng(4)
    vectors = [(rng.standard_normal(64), 1) for _ in range(400)] + [(rng.standard_normal(64), int(k)) for k in rng.integers(2, 6, 200)]
    base = rng.standard_normal(64)
    vectors += [(noisy(rng, base, 0.992), 1) for _ in range(600)] + [(base, 1)] * 150 + [(base, 2)] * 3      # dense, copies, other label
    other = rng.standard_normal(64)
    vectors += [(noisy(rng, other, 0.965), 3) for _ in range(80)]        # pairs around the limit
    step = rng.standard_normal(64)
    for _ in range(40):                                                  # a chain: only neighbours link
        step = noisy(rng, step, 0.95)
        vectors.append((step, 4))
    order = rng.permutation(len(vectors))
    rows = [(int(i) * 3, f32(vectors[k][0]), vectors[k][1]) for i, k in enumerate(order)]
    got, want = run(spark.createDataFrame(rows, SCHEMA).repartition(6)), brute.linked_vectors(rows)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert there > 600 * 750 and all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.99 * there
    dense = [i for i, v in want.items() if v[0] >= 700]
    assert len(dense) >= 750 and all(got[i] == want[i] for i in dense)


def test_recall_of_pairs_at_the_limit(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(600):
        base = rng.standard_normal(32)
        rows += [(2 * k, [float(x) for x in base], 0), (2 * k + 1, [float(x) for x in noisy(rng, base, 0.9301)], 0)]
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5))
    assert sum(v[0] for v in got.values()) >= 0.9 * 1200
    assert passes.passes_for(10 ** 10, 0.93) > passes.passes_for(10 ** 5, 0.93) >= passes.MIN_PASSES


def test_windows_reach_across_partitions(spark, monkeypatch):
    """Pairs that neighbour each other at a partition's edge are found in one pass."""
    rng = np.random.default_rng(2)
    rows = [(k, f32(noisy(rng, np.ones(16), 0.999)), 1) for k in range(300)]
    classes = passes.materialise(spark.createDataFrame(rows, SCHEMA).selectExpr(
        "unhex(md5(string(vec_id))) as _x_node", "'g' as _x_group", "embedding as _x_vec"), "classes")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = passes.sorted_pass(classes, 0, 0.93, 4)
        got = {r.node: r.root for r in passes.connected_components(links).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(got) == 300 and len(set(got.values())) == 1


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_blocks_of_uncovered_members(spark, monkeypatch, block):
    monkeypatch.setattr(passes, "BLOCK", block)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(24)
    rows = [(k, f32(noisy(rng, base, c)), 1) for k, c in enumerate([0.97] * 25 + [0.999] * 15)] + [(90 + k, f32(base), 1) for k in range(5)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute.linked_vectors(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 1), (7, [1.0, 2.0], None),
            (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0, 0.0], 1), (11, [1e-30, 2e-30], 1), (12, [1e30, 2e30], 1), (13, [1.0, 2.0], 2),
            (14, [-1.0, -2.0], 1), (15, [-0.0, 1.0], 3), (16, [0.0, 1.0], 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute.linked_vectors(rows)
    assert run(df) == want and want[8] == (3, 8) and want[16] == (1, 15)
    assert run(df.union(df)) == want                                                       # repeated rows are one vector
    more = spark.createDataFrame([(None, [1.0, 2.0], 1), (8, [5.0, -1.0], 1)], SCHEMA)      # a null id; an id with another vector
    odd = df.unionByName(more).selectExpr("*", "'x' as n_links", "3 as component_id", "4 as _x", "5 as node", "6 as a", "array(1) as KEPT")
    out = passes.link_vectors(odd).collect()
    assert len(out) == 18 and [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, True)]
    assert sorted((r.n_links, r.component_id) for r in out if r.vec_id == 8) == [(0, 8), (3, 8)]
    assert passes.link_vectors(df.limit(0)).count() == 0
    named = df.selectExpr("concat('v', vec_id) as vec_id", "embedding", "concat('l', label) as label")
    assert {r.vec_id: r.n_links for r in passes.link_vectors(named).collect()} == {f"v{i}": v[0] for i, v in want.items()}
