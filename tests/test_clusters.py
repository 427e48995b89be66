"""Clusters of the golden word lists, grids, and properties that must hold."""

import pytest
from pyspark.sql import functions as F

from tetrad.functions.strings import lcs
from tetrad.operators import analogies, clusters, features, grids
from tests import golden_clusters as golden

# Word lists with known numbers of clusters.
DUMMY = "makan makanan memakan dimakan pemakan minum minuman meminum peminum main mainan lihat melihat dilihat"
TINY = "makan dimakan makanan memakan makanlah termakan minum meminum diminum peminum minumlah terminum masak memasak masakan dimasak lihat dilihat melihat diperlihatkan"


def table(spark, words):
    return spark.createDataFrame([(w,) for w in words.split()], "word string")


def found(spark, words):
    v = features.char_vectors(table(spark, words))
    raw = clusters.raw_clusters(features.representatives(v))
    kept = clusters.filtered_clusters(raw, features.equivalence_classes(v))

    def sets(rows):
        out = {}
        for r in rows.collect():
            out.setdefault(r["cluster_id"], set()).add((r["a"], r["b"]))
        return {frozenset(min((a, b), (b, a)) for a, b in c) for c in out.values()}

    return sets(raw), sets(kept)


@pytest.mark.parametrize(("words", "raw", "kept"), [("toto tata popo papa", 2, 2), (DUMMY, 13, 13), (TINY, 19, 19)])
def test_golden_counts(spark, words, raw, kept):
    a, b = found(spark, words)
    assert (len(a), len(b)) == (raw, kept)
    if words.startswith("toto"):
        assert b == {frozenset({("tata", "toto"), ("papa", "popo")}), frozenset({("popo", "toto"), ("papa", "tata")})}


@pytest.mark.parametrize(("words", "kept", "dropped"), [(golden.SMALL, golden.SMALL_KEPT, golden.SMALL_DROPPED), (TINY, golden.TINY_KEPT, []), (DUMMY, golden.DUMMY_KEPT, [])])
def test_golden_sets(spark, words, kept, dropped):
    read = lambda lines: {frozenset(min((a, b), (b, a)) for a, b in (r.split(" : ") for r in line.split(" :: "))) for line in lines}
    assert found(spark, words) == (read([*kept, *dropped]), read(kept))


def test_distances_split_equal_differences(spark):
    """ambil : mengambil and keluaran : mengeluarkan have one difference, but not one distance pattern."""
    _, kept = found(spark, "ambil mengambil keluaran mengeluarkan")
    assert kept == set()


def test_every_pair_of_a_filtered_cluster_is_valid(spark):
    v = features.char_vectors(table(spark, TINY))
    kept = clusters.filtered_clusters(clusters.raw_clusters(features.representatives(v)), features.equivalence_classes(v))
    x, y = kept.alias("x"), kept.alias("y")
    pairs = x.join(y, "cluster_id").where("x.a < y.a").select("x.a", "x.b", F.col("y.a").alias("c"), F.col("y.b").alias("d")).collect()
    far = lambda p, q: len(p) + len(q) - 2 * lcs(p, q)
    assert pairs
    for a, b, c, d in pairs:
        assert sorted(a + d) == sorted(b + c) and far(a, b) == far(c, d) and far(a, c) == far(b, d)


def test_enrichment_is_closed(spark):
    quad = spark.createDataFrame([(1, "a", "b", "c", "d")], "id int, a string, b string, c string, d string")
    once = {tuple(r)[2:] for r in analogies.enriched(quad).collect()}
    twice = {tuple(r)[2:] for r in analogies.enriched(analogies.enriched(quad).drop("form")).collect()}
    assert len(once) == 8 and once == twice


def test_large_tables_meet_by_shares(spark, monkeypatch):
    v = features.representatives(features.char_vectors(table(spark, TINY)))
    small = sorted(map(tuple, clusters.raw_clusters(v).collect()))
    monkeypatch.setattr(clusters, "BROADCAST", 0)
    monkeypatch.setattr(clusters, "SHARES", 3)
    assert sorted(map(tuple, clusters.raw_clusters(v).collect())) == small


def test_cliques():
    edges = [{1, 2}, {0, 2}, {0, 1, 3}, {2}]
    assert list(clusters.covering_cliques(edges, 2)) == [[0, 1, 2], [2, 3]]
    assert clusters.maximal_cliques(edges) == [[0, 1, 2], [2, 3]]


def test_a_grid_grows_by_lines_and_places():
    made = grids.assemble([[("minum", "diminum"), ("makan", "dimakan"), ("beli", "dibeli")], [("minum", "makan"), ("minuman", "makanan"), ("diminum", "dimakan")], [("x", "y"), ("z", "w")]])
    assert len(made) == 2
    at = made[0].at
    assert at["minuman"][1] == at["minum"][1] and at["makanan"][1] == at["makan"][1] and at["minuman"][0] == at["makanan"][0]


def test_grid_cells_and_predictions(spark):
    words = "walk walked walking talk talked talking jump jumped"
    v = features.char_vectors(table(spark, words))
    kept = clusters.filtered_clusters(clusters.raw_clusters(features.representatives(v)))
    cells = grids.grids(kept)
    a = grids.attributes(cells).collect()
    assert all(0 < r["saturation"] <= 1 and r["filled"] <= r["size"] for r in a)
    assert "jumping" in {r["word"] for r in grids.predictable_words(cells).collect()}
