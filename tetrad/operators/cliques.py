"""All maximal cliques of a graph, one bounded search a vertex.

Vertices stand in the order of their degrees.  Every maximal clique is found
once, by the search of its first vertex: among the later neighbours of that
vertex, of which there are at most the root of twice the number of edges
whatever the hubs are, and held against the earlier ones.  What a search needs is
the edges between a vertex's neighbours, that is the triangles; these are found
by two equi-joins of edges that point from the earlier to the later end, and
each is sent to the searches of its first and of its second vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(edges: DataFrame) -> DataFrame:
    """(a, b): each edge once, from the end of smaller degree to that of the larger
    one, with both degrees; of equal degrees, from the smaller vertex.  Loops and
    edges with a null end go."""
    each = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = each.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    known = each.join(degree.select(F.col("v").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("v").alias("b"), F.col("n").alias("nb")), "b")
    turned = F.struct("na", "a") > F.struct("nb", "b")
    side = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    return known.select(side("b", "a").alias("a"), side("a", "b").alias("b"), side("nb", "na").alias("na"), side("na", "nb").alias("nb"))


def triangles(pointed: DataFrame) -> DataFrame:
    """(x, y, z): the triangles of pointed edges, vertices in their order."""
    one = pointed.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("nb").alias("ny"))
    two = pointed.select(F.col("a").alias("x"), F.col("b").alias("z"), F.col("nb").alias("nz"))
    wedges = one.join(two, "x").where(F.struct("ny", "y") < F.struct("nz", "z")).select("x", "y", "z")
    closing = pointed.select(F.col("a").alias("y"), F.col("b").alias("z"))
    return wedges.join(closing, ["y", "z"]).select("x", "y", "z")


def search(later: list[int], inner: dict[int, int], outer: list[int]) -> Iterator[list[int]]:
    """The maximal cliques among ``later``, which have all in common that they are
    neighbours of one vertex: sets of places are the bits of numbers.  ``inner``
    has the neighbours of each of them, by its bit's place, and ``outer`` those of
    the earlier vertices, which must not extend a clique."""
    whole = (1 << len(later)) - 1
    work = [(0, whole, [x for x in outer if x])]
    while work:
        held, maybe, done = work.pop()
        if not maybe:
            if not done:
                yield [v for i, v in enumerate(later) if held >> i & 1]
            continue
        # the pivot is the vertex, taken or not, that has the most of them as neighbours
        pivot = max((inner[i] & maybe for i in range(len(later)) if maybe >> i & 1), key=int.bit_count)
        pivot = max([pivot, *[x & maybe for x in done]], key=int.bit_count)
        rest = maybe & ~pivot
        while rest:
            bit = rest & -rest
            rest ^= bit
            near = inner[bit.bit_length() - 1]
            # of the excluded, those without a neighbour left are none of this branch's
            work.append((held | bit, maybe & near, [x for x in done if x & bit]))
            maybe ^= bit
            done = [*done, near]


def maximal_cliques(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(members): every maximal clique of the edges (a, b), its vertices in order;
    with ``vertices`` (v), also each of those that has no edge.

    A search holds a vertex's later neighbours and the triangles that it is first
    or second in; cliques are as many as there are, which may be very many.
    """
    kind = edges.schema["a"].dataType.simpleString()
    pointed = ordered(edges).persist()
    found = triangles(pointed)
    none = F.lit(None).cast(kind)
    sent = pointed.select(F.col("a").alias("v"), F.col("b").alias("p"), none.alias("q"), F.lit(False).alias("inner"))
    sent = sent.union(found.select("x", "y", "z", F.lit(True))).union(found.select("y", "x", "z", F.lit(False)))

    def searched(group: pa.Table) -> pa.Table:
        first = group.column("v")[0].as_py()
        rows = list(zip(*[group.column(c).to_pylist() for c in ("p", "q", "inner")], strict=True))
        later = sorted(p for p, q, _ in rows if q is None)
        at = {v: i for i, v in enumerate(later)}
        inner, outer = dict.fromkeys(range(len(later)), 0), {}
        for p, q, inside in rows:
            if inside:
                inner[at[p]] |= 1 << at[q]
                inner[at[q]] |= 1 << at[p]
            elif q is not None:
                outer[p] = outer.get(p, 0) | 1 << at[q]
        cliques = [sorted([first, *c]) for c in search(later, inner, sorted(set(outer.values())))]
        return pa.table({"members": pa.array(cliques, pa.list_(group.schema.field("v").type))})

    out = sent.groupBy("v").applyInArrow(searched, f"members array<{kind}>")
    if vertices is None:
        return out
    joined = edges.where("a <> b").select(F.explode(F.array("a", "b")).alias("v")).distinct()
    return out.union(vertices.where("v is not null").select("v").distinct().join(joined, "v", "left_anti").select(F.array("v")))


def consistent_cliques(parts: DataFrame) -> DataFrame:
    """(cluster_id, d, members): all maximal sets of ratios (a, b) of each cluster
    and distance whose distances agree with each other, d(a, a') = d(b, b');
    ratios as structs.  Where covering cliques take one look, these are all there are.
    """
    from tetrad.functions.strings import lcs_distance_arrow

    named = parts.select("cluster_id", "d", F.struct("cluster_id", "d", "a", "b").alias("v")).distinct()
    x, y = named.alias("x"), named.alias("y")
    same = (F.col("x.cluster_id") == F.col("y.cluster_id")) & (F.col("x.d") == F.col("y.d")) & (F.col("x.v") < F.col("y.v"))
    pairs = x.join(y, same).select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    agree = lcs_distance_arrow("a.a", "b.a") == lcs_distance_arrow("a.b", "b.b")
    text = lambda c: F.to_json(c).alias(c)
    edges = pairs.where(agree).select(text("a"), text("b"))
    found = maximal_cliques(edges, named.select(F.to_json("v").alias("v")))
    shape = "struct<cluster_id: string, d: int, a: string, b: string>"
    read = found.select(F.transform("members", lambda m: F.from_json(m, shape)).alias("m"))
    return read.select(F.col("m")[0]["cluster_id"].alias("cluster_id"), F.col("m")[0]["d"].alias("d"), F.transform("m", lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"))).alias("members"))
