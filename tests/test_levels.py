"""The prefix tree and the clusters by levels, against plain versions."""

import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from tetrad.operators import clusters, features, levels


def made(seed, n, letters="aabbcdefghij", most=7):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(1, most))) for _ in range(n)})


def vectors(spark, words):
    return features.representatives(features.char_vectors(spark.createDataFrame([(w,) for w in words], "word string").repartition(3)))


def plain_tree(rows):
    """Nodes by level: (level, start, stop, size, value, empty_rest)."""
    rows, out = sorted(set(map(tuple, rows))), []
    for level in range(len(rows[0]) + 1):
        blocks = defaultdict(list)
        for i, v in enumerate(rows):
            blocks[v[:level]].append(i)
        for prefix, at in blocks.items():
            rest = len(at) == 1 and not any(rows[at[0]][max(level, 1) - 1 :])
            out.append((level, at[0], at[-1] + 1, len(at), prefix[-1] if prefix else 0, rest))
    return sorted(out)


def test_tree(spark):
    v = vectors(spark, made(1, 200)).persist()
    want = plain_tree([r["v"] for r in v.collect()])
    assert sorted(map(tuple, levels.nodes(v).collect())) == want
    linked = [r.asDict() for r in levels.linked(levels.nodes(v)).orderBy("number").collect()]
    assert [r["number"] for r in linked] == list(range(len(want)))
    assert [tuple(r[c] for c in ("level", "start", "stop", "size", "value", "empty_rest")) for r in linked] == want
    deepest = max(r["level"] for r in linked)
    for r in linked:
        if r["level"] == deepest:
            assert r["first_child"] == r["last_child"] == -1
            continue
        inside = [c for c in linked if c["level"] == r["level"] + 1 and r["start"] <= c["start"] and c["stop"] <= r["stop"]]
        assert (inside[0]["number"], inside[-1]["number"]) == (r["first_child"], r["last_child"]) and sum(c["size"] for c in inside) == r["size"]


def test_clusters_are_the_raw_ones(spark):
    for seed, n, least in ((2, 150, 2), (3, 300, 3), (4, 400, 5)):
        v = vectors(spark, made(seed, n)).persist()
        want = sorted(map(tuple, clusters.raw_clusters(v, least=least).collect()))
        assert sorted(map(tuple, levels.clusters(v, least).collect())) == want and want
        count = defaultdict(int)
        for r in clusters.raw_clusters(v, least=least).select("cluster_id", "size").distinct().collect():
            count[r["size"]] += 1
        assert {r["size"]: r["freq"] for r in levels.sizes(v, least).collect()} == dict(count)


def test_nodes_joined_beyond_the_bound(spark, monkeypatch):
    v = vectors(spark, made(5, 120)).persist()
    want = sorted(map(tuple, levels.clusters(v).collect()))
    monkeypatch.setattr(levels, "BROADCAST", 10)
    assert sorted(map(tuple, levels.clusters(v).collect())) == want


def test_pairs_of_small_groups_are_not_expanded(spark):
    """On the last level, pairs whose difference so far nobody else has are gone; what is left is known."""
    words = made(6, 200)
    v = vectors(spark, words).persist()
    rows = [r["v"] for r in v.collect()]
    found = [tuple(r) for r in levels.report(v).orderBy("level").collect()]
    order = levels._places(v)
    rare = sorted(tuple(x[i] for i in order) for x in rows)
    last = found[-2][0]
    alike = defaultdict(int)
    for x, y in combinations(rare, 2):
        alike[tuple(p - q for p, q in zip(x[:last], y[:last], strict=True))] += 1
    assert found[-1][1] == sum(n for n in alike.values() if n >= 2) < len(rare) * (len(rare) - 1) // 2
    assert found[0][2] == len(rare) * (len(rare) - 1) // 2


def test_pairs_of_vectors_are_not_shuffled(spark):
    v = vectors(spark, made(7, 150)).persist()
    text = levels.sizes(v)._jdf.queryExecution().executedPlan().toString()
    # what is counted by group stands where the groups were dealt: only their sizes are exchanged
    above = text.split("partial_count(1)")
    assert "Exchange" not in above[2].split("xxhash64(d1")[0]


def test_few_or_no_vectors(spark):
    none = spark.createDataFrame([], "word string, v array<int>")
    for v in (none, spark.createDataFrame([("a", [1, 0])], "word string, v array<int>"), spark.createDataFrame([("", [])], "word string, v array<int>")):
        assert levels.clusters(v).count() == levels.sizes(v).count() == levels.report(v).count() == 0
    assert levels.nodes(none).count() == 0 and levels.linked(levels.nodes(none)).count() == 0


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(x,) for x in random.Random(8).sample(range(10_000), 500)], "x int").repartition(7)
    got = [tuple(r) for r in levels.ranked(rows, "x", "n").orderBy("n").collect()]
    assert [n for _, n in got] == list(range(500)) and [x for x, _ in got] == sorted(r["x"] for r in rows.select(F.col("x")).collect())
