"""All maximal cliques, against a plain search."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tetrad.functions.strings import lcs
from tetrad.operators import cliques, clusters


def plain(vertices, edges):
    near = {v: set() for v in vertices}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return sorted(sorted(vertices[i] for i in c) for c in clusters.maximal_cliques([{vertices.index(w) for w in near[v]} for v in vertices]))


def found(df):
    return sorted(r["members"] for r in df.collect())


@pytest.mark.parametrize(("n", "share", "seed"), [(30, 0.3, 1), (25, 0.7, 2), (60, 0.1, 3), (12, 1.0, 4)])
def test_random_graphs(spark, n, share, seed):
    r = random.Random(seed)
    edges = [(a, b) for a, b in combinations(range(n), 2) if r.random() < share]
    given = [(b, a) if r.random() < 0.5 else (a, b) for a, b in edges] + edges[:5] + [(3, 3), (None, 2)]
    df = spark.createDataFrame(given, "a long, b long").repartition(4)
    vertices = spark.createDataFrame([(v,) for v in [*range(n), 0, None]], "v long")
    assert found(cliques.maximal_cliques(df, vertices)) == plain(list(range(n)), edges)
    assert found(cliques.maximal_cliques(df)) == [c for c in plain(list(range(n)), edges) if len(c) > 1]


def test_hub_and_copies(spark):
    """A hub with a neighbour in every triangle is searched by its neighbours, not by itself."""
    edges = [(0, v) for v in range(1, 400)] + [(v, v + 1) for v in range(1, 399, 2)]
    df = spark.createDataFrame(edges, "a long, b long")
    out = {r["a"]: r["n"] for r in cliques.ordered(df).groupBy("a").agg(F.count("*").alias("n")).collect()}
    assert 0 not in out and max(out.values()) <= 2
    assert found(cliques.maximal_cliques(df)) == sorted([0, v, v + 1] if v < 399 else [0, v] for v in range(1, 400, 2))
    none = df.limit(0)
    assert cliques.maximal_cliques(none).count() == 0
    assert found(cliques.maximal_cliques(none, spark.createDataFrame([(7,)], "v long"))) == [[7]]


def test_consistent_ratios(spark):
    lines = ["a : aa :: aa : aaa :: bab : baba :: abb : babb", "x : y :: z : xy"]
    rows = [(str(n), 1, *r.split(" : ")) for n, line in enumerate(lines) for r in line.split(" :: ")]
    far = lambda x, y: len(x) + len(y) - 2 * lcs(x, y)
    want = []
    for n in ("0", "1"):
        ratios = sorted((a, b) for c, _, a, b in rows if c == n)
        edges = [(x, y) for x, y in combinations(ratios, 2) if far(x[0], y[0]) == far(x[1], y[1])]
        want += [(n, 1, c) for c in plain(ratios, edges)]
    got = cliques.consistent_cliques(spark.createDataFrame(rows, "cluster_id string, d int, a string, b string"))
    assert sorted((r["cluster_id"], r["d"], sorted(map(tuple, r["members"]))) for r in got.collect()) == sorted(want)
