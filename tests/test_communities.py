"""Communities by joins, against the driver's version and planted ones."""

import random
from itertools import combinations

from tetrad.operators import communities, transfer


def planted(seed, sizes, inside, between):
    r = random.Random(seed)
    of = [k for k, n in enumerate(sizes) for _ in range(n)]
    edges = [(f"v{i:03d}", f"v{j:03d}", 1.0) for i, j in combinations(range(len(of)), 2) if r.random() < (inside if of[i] == of[j] else between)]
    return of, edges


def groups(rows):
    out = {}
    for v, c in rows:
        out.setdefault(c, set()).add(v)
    return sorted(map(sorted, out.values()))


def plain_modularity(edges, label):
    total = 2 * sum(w for *_, w in edges)
    q = 0.0
    for c in set(label.values()):
        degree = sum(w for a, b, w in edges for x in (a, b) if label[x] == c)
        q += 2 * sum(w for a, b, w in edges if label[a] == label[b] == c) / total - (degree / total) ** 2
    return q


def test_planted_communities(spark):
    of, edges = planted(1, [14, 10, 12], 0.8, 0.03)
    df = spark.createDataFrame([(b, a, w) if i % 2 else (a, b, w) for i, (a, b, w) in enumerate(edges)], "a string, b string, w double").repartition(3)
    got = [tuple(r) for r in communities.communities(df).collect()]
    want = {}
    for i, k in enumerate(of):
        want.setdefault(k, []).append(f"v{i:03d}")
    assert groups(got) == sorted(want.values()) and all(c == min(v for v, x in got if x == c) for _, c in got)
    adjacency = spark.createDataFrame(edges, "l1 string, l2 string, weight double")
    assert groups([tuple(r) for r in transfer.communities(adjacency).collect()]) == groups(got)
    label = spark.createDataFrame(got, "v string, c string")
    assert abs(communities.modularity(df, label) - plain_modularity(edges, dict(got))) < 1e-9


def test_as_good_as_the_drivers(spark):
    """Where communities are not plain, modularity is about that of moves one by one."""
    _, edges = planted(2, [9, 8, 7], 0.5, 0.12)
    got = dict(tuple(r) for r in communities.communities(spark.createDataFrame(edges, "a string, b string, w double")).collect())
    driver = dict(tuple(r) for r in transfer.communities(spark.createDataFrame(edges, "l1 string, l2 string, weight double")).collect())
    assert plain_modularity(edges, got) > plain_modularity(edges, driver) - 0.05


def test_odd_graphs(spark):
    shape = "a long, b long, w double"
    run = lambda rows: sorted(map(tuple, communities.communities(spark.createDataFrame(rows, shape)).collect()))
    assert run([]) == [] and run([(None, 1, 1.0), (1, 2, None), (1, 2, 0.0)]) == []
    assert run([(5, 3, 1.0), (3, 5, 1.0), (9, 9, 2.0)]) == [(3, 3), (5, 3), (9, 9)]
    star = [(0, v, 1.0) for v in range(1, 40)]
    assert {c for _, c in run(star)} == {0} or len({c for _, c in run(star)}) < 10
