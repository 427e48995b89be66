"""Analogical clusters: pairs of words with the same vector difference.

A cluster's ratios are a long table (cluster_id, a, b); the id is the
difference itself, and for parts of a cluster the difference, the distance and
the part's first ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetrad.functions.strings import alphagram, lcs_distance, lcs_length, multiset_minus

#: Up to so many vectors are broadcast in the self-join; the size is counted first.
BROADCAST = 20_000
#: Beyond it, words are dealt into so many shares, and pairs of shares are joined on their numbers.
SHARES = 64


def _difference(a: str, b: str) -> F.Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def ratio_pairs(vectors: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(a, b, d): pairs of words with their vector difference.

    Within one table a comes before b in the order of the vectors; between two
    tables all pairs are taken.  Every pair is wanted, so the work is the number
    of pairs; small tables go to all tasks, larger ones meet share by share, in
    a plain equi-join.
    """
    left = vectors.select(F.col("word").alias("a"), F.col("v").alias("va"))
    right = (vectors if other is None else other).select(F.col("word").alias("b"), F.col("v").alias("vb"))
    meet = F.col("va") < F.col("vb") if other is None else F.lit(True)
    if right.count() <= BROADCAST:
        joined = left.repartition("a").join(F.broadcast(right), meet) if other is None else left.repartition("a").crossJoin(F.broadcast(right))
    else:
        shares = F.array(*[F.lit(i) for i in range(SHARES)])
        share = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARES)).cast("int")
        dealt = left.withColumn("i", share("a")).withColumn("j", F.explode(shares))
        dealt2 = right.withColumn("j", share("b")).withColumn("i", F.explode(shares))
        joined = dealt.join(dealt2, ["i", "j"]).where(meet)
    return joined.select("a", "b", _difference("va", "vb").alias("d"))


def raw_clusters(vectors: DataFrame, least: int = 2, most: int | None = None, other: DataFrame | None = None, focus: str | None = None) -> DataFrame:
    """(cluster_id, size, a, b): ratios of the clusters of least to most ratios.

    A first pass counts differences by their hash alone, without the words; the
    pairs of the rest are then grouped by the difference itself.  With ``focus``,
    only clusters that have that word, or another one of its letters, stay: a
    word is found by its alphagram, so also by an equivalent of its representative.
    """
    pairs = ratio_pairs(vectors, other)
    hashed = pairs.select(F.xxhash64("d").alias("h"), "a", "b")
    is_it = lambda c: alphagram(c) == alphagram(F.lit(focus))
    if focus is not None:
        about = hashed.where(is_it("a") | is_it("b")).select("h").distinct()
        hashed = hashed.join(about, "h", "left_semi")
    often = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("h")
    kept = pairs.withColumn("h", F.xxhash64("d")).join(often, "h", "left_semi")
    named = kept.select(F.array_join("d", ",").alias("cluster_id"), "a", "b")
    size = F.count(F.lit(1)).over(Window.partitionBy("cluster_id"))
    sized = named.withColumn("size", size.cast("long")).where(F.col("size") >= least)
    if most is not None:
        sized = sized.where(F.col("size") <= most)
    if focus is not None:
        has = F.max((is_it("a") | is_it("b")).cast("int")).over(Window.partitionBy("cluster_id"))
        sized = sized.withColumn("_has", has).where("_has = 1").drop("_has")
    return sized.select("cluster_id", "size", "a", "b")


def expanded(ratios: DataFrame, classes: DataFrame) -> DataFrame:
    """Ratios of representatives as ratios of all their equivalents."""
    of = classes.select("rep", F.explode("members").alias("w"))
    first = ratios.join(of.select(F.col("rep").alias("a"), F.col("w").alias("a2")), "a")
    both = first.join(of.select(F.col("rep").alias("b"), F.col("w").alias("b2")), "b")
    return both.select("cluster_id", F.col("a2").alias("a"), F.col("b2").alias("b"))


def horizontal_split(ratios: DataFrame, least: int = 2) -> DataFrame:
    """(cluster_id, d, a, b): ratios of equal d(a, b) within a cluster.  The
    distance is found once for each different ratio."""
    far = ratios.select("a", "b").distinct().withColumn("d", lcs_distance("a", "b"))
    measured = ratios.join(far, ["a", "b"])
    n = F.count(F.lit(1)).over(Window.partitionBy("cluster_id", "d"))
    return measured.withColumn("_n", n).where(F.col("_n") >= least).select("cluster_id", "d", "a", "b")


def covering_cliques(edges: list[set[int]], least: int) -> Iterator[list[int]]:
    """Cliques that cover the vertices: from each vertex not yet covered, those
    of most edges first, grow a clique by one look at every vertex."""
    order = sorted(range(len(edges)), key=lambda v: (-len(edges[v]), v))
    covered: set[int] = set()
    for v in order:
        if v in covered:
            continue
        clique = [v]
        for w in order:
            if w != v and all(w in edges[u] for u in clique):
                clique.append(w)
        covered.update(clique)
        if len(clique) >= least:
            yield sorted(clique)


def maximal_cliques(edges: list[set[int]]) -> list[list[int]]:
    """All maximal cliques, with a pivot to keep the search short."""
    out: list[list[int]] = []
    work = [(set(), set(range(len(edges))), set())]
    while work:
        held, maybe, done = work.pop()
        if not maybe:
            if not done and held:
                out.append(sorted(held))
            continue
        pivot = max(maybe | done, key=lambda v: len(edges[v] & maybe))
        for v in sorted(maybe - edges[pivot]):
            work.append((held | {v}, maybe & edges[v], done & edges[v]))
            maybe = maybe - {v}
            done = done | {v}
    return sorted(out)


def vertical_split(parts: DataFrame, least: int = 2) -> DataFrame:
    """(cluster_id, d, part, a, b): covering cliques of the ratios whose
    distances agree, d(a, a') = d(b, b'), within each part of equal d.

    The part's name is its number and first ratio.  Greedy by nature, hence one grouped map
    for each cluster and distance.
    """
    from tetrad.functions.strings import lcs

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"], ignore_index=True)
        a, b = rows["a"].tolist(), rows["b"].tolist()
        known: dict[tuple[str, str], int] = {}

        def far(x: str, y: str) -> int:
            if (x, y) not in known:
                known[x, y] = known[y, x] = len(x) + len(y) - 2 * lcs(x, y)
            return known[x, y]

        edges: list[set[int]] = [set() for _ in a]
        for i in range(len(a)):
            for j in range(i):
                if far(a[i], a[j]) == far(b[i], b[j]):
                    edges[i].add(j)
                    edges[j].add(i)
        made = []
        for n, clique in enumerate(covering_cliques(edges, least)):
            part = f"{n}:{a[clique[0]]} : {b[clique[0]]}"
            made += [(rows["cluster_id"][0], rows["d"][0], part, a[i], b[i]) for i in clique]
        return pd.DataFrame(made, columns=["cluster_id", "d", "part", "a", "b"])

    return parts.groupBy("cluster_id", "d").applyInPandas(cut, "cluster_id string, d int, part string, a string, b string")


def without_repeated_words(ratios: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Ratios whose a and b occur once each in their cluster; clusters of least ratios or more."""
    once = ratios.withColumn("_a", F.count(F.lit(1)).over(Window.partitionBy(*keys, "a"))).withColumn("_b", F.count(F.lit(1)).over(Window.partitionBy(*keys, "b"))).where("_a = 1 and _b = 1")
    return once.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_a", "_b", "_n")


def filtered_clusters(ratios: DataFrame, classes: DataFrame | None = None, least: int = 2, most: int | None = None) -> DataFrame:
    """(cluster_id, a, b): clusters that also agree in distances, without repeated
    words.  The id is the difference, the distance and the first ratio."""
    source = ratios.select("cluster_id", "a", "b")
    source = expanded(source, classes) if classes is not None else source
    parts = vertical_split(horizontal_split(source, least), least)
    kept = without_repeated_words(parts, ["cluster_id", "d", "part"], least)
    named = kept.select(F.concat_ws("|", "cluster_id", F.col("d").cast("string"), "part").alias("cluster_id"), "a", "b")
    if most is not None:
        named = named.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cluster_id"))).where(F.col("_n") <= most).drop("_n")
    return named


def filter_words(ratios: DataFrame, words: DataFrame, delete: bool) -> DataFrame:
    """Keep (or delete) the ratios whose words are both (or either) in the list;
    clusters of two ratios or more stay."""
    how = "left_anti" if delete else "left_semi"
    kept = ratios.join(words.select(F.col("word").alias("a")), "a", how).join(words.select(F.col("word").alias("b")), "b", how)
    return kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cluster_id"))).where("_n > 1").select("cluster_id", "a", "b")


def normalized(ratios: DataFrame) -> DataFrame:
    """All ratios of a cluster turned round if the first one's a is longer than
    its b; then in a cluster of two ratios a : b :: c : d, b and c change places
    if a has less in common with b than with c (longest common subsequences).
    The first ratio is the smallest of the cluster as it comes."""
    whole = Window.partitionBy("cluster_id")
    placed = ratios.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_k", F.row_number().over(whole.orderBy("a", "b")))
    first = F.min_by(F.struct("a", "b"), F.col("_k")).over(whole)
    turn = F.length(first["a"]) > F.length(first["b"])
    turned = placed.select("cluster_id", "_n", "_k", F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
    several = turned.where("_n <> 2").select("cluster_id", "a", "b")
    two = turned.where("_n = 2").groupBy("cluster_id").agg(*[F.max(F.when(F.col("_k") == k, F.col(c))).alias(name) for k, c, name in ((1, "a", "a"), (1, "b", "b"), (2, "a", "c"), (2, "b", "d"))])
    swap = lcs_length("a", "b") < lcs_length("a", "c")
    b, c = F.when(swap, F.col("c")).otherwise(F.col("b")), F.when(swap, F.col("b")).otherwise(F.col("c"))
    pair = F.explode(F.array(F.struct(F.col("a").alias("a"), b.alias("b")), F.struct(c.alias("a"), F.col("d").alias("b"))))
    return several.union(two.select("cluster_id", pair.alias("r")).select("cluster_id", "r.a", "r.b"))


def median_order(ratios: DataFrame) -> DataFrame:
    """(cluster_id, rank, a, b, total): ratios by the sum of their distances, as
    written, ``a : b``, to all others of the cluster; exact, of all of them."""
    written = ratios.select("cluster_id", "a", "b", F.concat("a", F.lit(" : "), "b").alias("r"))
    x, y = written.alias("x"), written.alias("y")
    pairs = x.join(y, (F.col("x.cluster_id") == F.col("y.cluster_id")) & (F.col("x.r") < F.col("y.r"))).select(F.col("x.cluster_id").alias("cluster_id"), F.col("x.r").alias("r"), F.col("y.r").alias("other"))
    far = pairs.select("r", "other").distinct().withColumn("d", lcs_distance("r", "other"))
    measured = pairs.join(far, ["r", "other"])
    total = measured.select("cluster_id", "r", "d").union(measured.select("cluster_id", "other", "d")).groupBy("cluster_id", "r").agg(F.sum("d").alias("total"))
    ordered = written.join(total, ["cluster_id", "r"], "left").select("cluster_id", "a", "b", F.coalesce("total", F.lit(0)).alias("total"))
    return ordered.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("total", "a", "b")))


def attributes(ratios: DataFrame) -> DataFrame:
    """(cluster_id, distance, left_diff, right_diff) of each cluster's first ratio."""
    first = ratios.groupBy("cluster_id").agg(F.min(F.struct("a", "b")).alias("r")).select("cluster_id", "r.a", "r.b")
    return first.select("cluster_id", lcs_distance("a", "b").alias("distance"), multiset_minus("a", "b").alias("left_diff"), multiset_minus("b", "a").alias("right_diff"))


def intersection(one: DataFrame, other: DataFrame) -> DataFrame:
    """(cluster_id, other_id): clusters of the same attributes."""
    keys = ["distance", "left_diff", "right_diff"]
    return attributes(one).join(attributes(other).withColumnRenamed("cluster_id", "other_id"), keys).select("cluster_id", "other_id")


def all_distances_agree(ratios: DataFrame) -> DataFrame:
    """(cluster_id, agree): whether d(a, a') = d(b, b') for all pairs of ratios,
    and d(a, b) is the same for all ratios."""
    x, y = ratios.alias("x"), ratios.alias("y")
    pairs = x.join(y, (F.col("x.cluster_id") == F.col("y.cluster_id")) & (F.struct("x.a", "x.b") < F.struct("y.a", "y.b")))
    agree = (lcs_distance("x.a", "y.a") == lcs_distance("x.b", "y.b")) & (lcs_distance("x.a", "x.b") == lcs_distance("y.a", "y.b"))
    return pairs.select(F.col("x.cluster_id").alias("cluster_id"), agree.alias("agree")).groupBy("cluster_id").agg(F.bool_and("agree").alias("agree"))


def no_duplicate_words(ratios: DataFrame) -> DataFrame:
    """(cluster_id, unique): whether no word is the a, or the b, of two ratios, or both of one."""
    once = (F.count_distinct("a") == F.count(F.lit(1))) & (F.count_distinct("b") == F.count(F.lit(1))) & F.bool_and(F.col("a") != F.col("b"))
    return ratios.groupBy("cluster_id").agg(once.alias("unique"))


def marked(ratios: DataFrame) -> DataFrame:
    """(cluster_id, mark): OOO for clusters with duplicate words whose distances
    agree all the same, XXX for those whose distances do not, else nothing."""
    both = no_duplicate_words(ratios).join(all_distances_agree(ratios), "cluster_id", "left")
    return both.select("cluster_id", F.when(F.col("unique"), "").when(F.coalesce("agree", F.lit(True)), "OOO ").otherwise("XXX ").alias("mark"))


def look_up(ratios: DataFrame, word: str) -> DataFrame:
    """(cluster_id) of the clusters that have the word."""
    return ratios.where((F.col("a") == word) | (F.col("b") == word)).select("cluster_id").distinct()


def meeting(one: DataFrame, other: DataFrame) -> DataFrame:
    """(cluster_id, other_id): pairs of clusters that have a word in common; all
    other pairs have an empty intersection."""
    words = lambda r, name: r.select(F.col("cluster_id").alias(name), F.explode(F.array("a", "b")).alias("word")).distinct()
    return words(one, "cluster_id").join(words(other, "other_id"), "word").select("cluster_id", "other_id").distinct()


def empty_intersections(pairs: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """The given pairs (cluster_id, other_id) of clusters without a word in common."""
    return pairs.join(meeting(one, other), ["cluster_id", "other_id"], "left_anti")


def gamma_hypothesis(ratios: DataFrame) -> DataFrame:
    """Clusters of more than two ratios, and those of two a : b :: c : d in which
    s(x, y) + s(x, z) - |x| is the same for each word x and its two neighbours,
    where s(x, y) = |x| + |y| - 2 d(x, y)."""
    whole = Window.partitionBy("cluster_id")
    sized = ratios.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_k", F.row_number().over(whole.orderBy("a", "b")))
    two = sized.where("_n = 2").groupBy("cluster_id").agg(*[F.max(F.when(F.col("_k") == k, F.col(c))).alias(name) for k, c, name in ((1, "a", "a"), (1, "b", "b"), (2, "a", "c"), (2, "b", "d"))])
    same = lambda x, y: F.length(x) + F.length(y) - 2 * lcs_distance(x, y)
    gamma = [same(x, y) + same(x, z) - F.length(x) for x, y, z in (("a", "b", "c"), ("b", "a", "d"), ("c", "a", "d"), ("d", "b", "c"))]
    good = two.where((gamma[0] == gamma[1]) & (gamma[1] == gamma[2]) & (gamma[2] == gamma[3])).select("cluster_id")
    return sized.where("_n > 2").select("cluster_id", "a", "b").union(ratios.join(good, "cluster_id", "left_semi").select("cluster_id", "a", "b"))


def neighbours(edges: DataFrame, vertex: int) -> DataFrame:
    """(v): the vertices that have an edge (a, b) with this one."""
    return edges.where((F.col("a") == vertex) | (F.col("b") == vertex)).select(F.when(F.col("a") == vertex, F.col("b")).otherwise(F.col("a")).alias("v")).distinct()


def random_edges(vertices: DataFrame, share: float = 0.5, seed: int = 0) -> DataFrame:
    """(a, b), a < b: a symmetric relation that has that share of all pairs of the
    vertices (v), by a hash of the pair; every pair is thrown for, by definition."""
    thrown = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "a", "b", F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint"), F.lit(1000))
    every = vertices.select(F.col("v").alias("a"), F.sequence(F.col("v") + 1, F.lit(vertices.agg(F.max("v")).first()[0])).alias("bs"))
    pairs = every.where(F.col("a") < F.element_at("bs", -1)).select("a", F.explode("bs").alias("b")).join(vertices.select(F.col("v").alias("b")), "b")
    return pairs.where(thrown < int(share * 1000)).select("a", "b")


def discrepancies(ratios: DataFrame) -> DataFrame:
    """(cluster_id, a, b, n): with how many other ratios each one disagrees."""
    x, y = ratios.alias("x"), ratios.alias("y")
    pairs = x.join(y, (F.col("x.cluster_id") == F.col("y.cluster_id")) & (F.struct("x.a", "x.b") != F.struct("y.a", "y.b")))
    off = (lcs_distance("x.a", "y.a") != lcs_distance("x.b", "y.b")).cast("int")
    return pairs.groupBy(F.col("x.cluster_id").alias("cluster_id"), F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.sum(off).alias("n"))


def statistics(ratios: DataFrame) -> DataFrame:
    """(size, freq): how many clusters have so many ratios."""
    return ratios.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("freq"))


def report(ratios: DataFrame, classes: DataFrame) -> DataFrame:
    """(what, size, n): how many classes of equivalents, and how many clusters,
    are of each size; how many clusters have duplicate words, or distances that
    do not agree (size is null)."""
    of_classes = classes.groupBy(F.size("members").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("class").alias("what"), "size", "n")
    of_clusters = statistics(ratios).select(F.lit("cluster").alias("what"), "size", F.col("freq").alias("n"))
    bad = lambda df, c, what: df.agg(F.count_if(~F.col(c)).alias("n")).select(F.lit(what).alias("what"), F.lit(None).cast("long").alias("size"), "n")
    return of_classes.union(of_clusters).union(bad(no_duplicate_words(ratios), "unique", "duplicate words")).union(bad(all_distances_agree(ratios), "agree", "distances differ"))


def surface(one: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(pairs): how many pairs of words a clustering looks at."""
    n = one.agg(F.count(F.lit(1)).alias("x"))
    if other is None:
        return n.select((F.col("x") * (F.col("x") - 1) / 2).cast("long").alias("pairs"))
    m = other.agg(F.count(F.lit(1)).alias("y"))
    return n.join(m, F.lit(True)).select((F.col("x") * F.col("y")).alias("pairs"))


def paradigm_lexicon(ratios: DataFrame) -> DataFrame:
    """(word, degree, partners), the words of most partners first."""
    both = ratios.select(F.col("a").alias("word"), F.col("b").alias("other")).union(ratios.select(F.col("b").alias("word"), F.col("a").alias("other")))
    found = both.groupBy("word").agg(F.array_sort(F.collect_set("other")).alias("partners"))
    return found.select("word", F.size("partners").alias("degree"), "partners").orderBy(F.desc("degree"), F.desc("word"))


def annotated_lexicon(ratios: DataFrame) -> DataFrame:
    """(word, notes): the median ratio of each cluster that has the word, with the
    word's side of it in angle brackets."""
    median = median_order(ratios).where("rank = 1").select("cluster_id", F.struct("a", "b").alias("m"))
    named = ratios.join(median, "cluster_id")
    left = named.select(F.col("a").alias("word"), F.concat(F.lit("<"), F.col("m.a"), F.lit("> : "), F.col("m.b")).alias("note"))
    right = named.select(F.col("b").alias("word"), F.concat(F.col("m.a"), F.lit(" : <"), F.col("m.b"), F.lit(">")).alias("note"))
    return left.union(right).groupBy("word").agg(F.array_sort(F.collect_set("note")).alias("notes"))
