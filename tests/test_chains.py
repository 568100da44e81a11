import random

import pytest

from commitlens.operators import chains


def brute(edges):
    nx = dict(edges)
    prev = {}
    for p, n in sorted(edges, reverse=True):
        if n is not None:
            prev[n] = p
    out = {}
    for p in nx:
        if prev.get(p) is None:
            chain = [p]
            while nx.get(chain[-1]) in nx and prev[nx[chain[-1]]] == chain[-1]:
                chain.append(nx[chain[-1]])
            last = nx[chain[-1]]
            state = "complete" if last is None else "merged" if last in nx else "broken"
            for i, x in enumerate(chain):
                out[x] = (p, i, len(chain), state)
    for p in nx:
        if p not in out:
            ring, q = {p}, prev[p]
            while q != p:
                ring.add(q)
                q = prev[q]
            out[p] = (min(ring), None, len(ring), "cyclic")
    return out


def run(spark, edges):
    df = spark.createDataFrame(edges, "page int, next_page int").repartition(3)
    return {r.page: (r.listing, r.position, r.n_pages, r.state) for r in chains.rank_chains(df).collect()}


def test_long_chain_cycle_and_breaks(spark):
    edges = [(i, i + 1) for i in range(1000)] + [(1000, None)]                     # one listing of 1,001 pages
    edges += [(2000 + i, 2000 + (i + 1) % 37) for i in range(37)]                  # a ring
    edges += [(3000, 3000), (3100, 3101), (3101, 9999), (3200, None)]              # a page that leads to itself, a missing page, a single page
    edges += [(4000, 4001), (4001, 4002), (4002, 4001), (5000, 500), (5001, 4002)]  # into a ring, into another listing
    got = run(spark, edges)
    assert got == brute(edges)
    assert got[1000] == (0, 1000, 1001, "complete") and got[2036] == (2000, None, 37, "cyclic") and got[3101] == (3100, 1, 2, "broken") and got[5000][3] == "merged"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links(spark, seed):
    rnd = random.Random(seed)
    edges = [(i, rnd.choice([None, rnd.randrange(150), i + 1, i + 1])) for i in range(120)]
    assert run(spark, edges) == brute(edges)


def test_odd_tables(spark):
    rows = [(1, 2), (1, 2), (1, 5), (2, None), (None, 1), (None, None)]
    assert run(spark, rows) == {1: (1, 0, 2, "complete"), 2: (1, 1, 2, "complete")}
    assert chains.rank_chains(spark.createDataFrame([], "page string, next_page string")).count() == 0
