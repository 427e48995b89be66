"""Communities of a weighted graph by modularity, found by joins.

Every vertex begins as a community of its own.  In a round, vertices move to the
neighbouring community in which modularity gains most; all those of one half, as
a hash says, move at once, and the halves are others in every round, so that
neighbours do not keep changing places.  When no vertex has moved in both halves,
or rounds gain nothing any more, communities become the vertices of a smaller
graph, and it goes on there until nothing merges.

What a round needs is one row for each vertex and neighbouring community, a sum
by group; no vertex's edges are gathered in one place, and the driver sees one
number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.operators.grids import kept

#: Rounds of one level at most, and how many may pass without a gain.
ROUNDS, PATIENCE = 40, 4


def _both(edges: DataFrame) -> DataFrame:
    """(v, u, w): each edge from both ends, loops once from each as well; equal edges as one."""
    one = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))
    return one.select(F.col("a").alias("v"), F.col("b").alias("u"), "w").union(one.select("b", "a", "w"))


def modularity(edges: DataFrame, label: DataFrame) -> float:
    """Of edges (a, b, w) under the communities (v, c) of their vertices."""
    return _quality(_both(edges), label)


def _quality(both: DataFrame, label: DataFrame) -> float:
    known = both.join(label, "v").join(label.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u")
    of = known.groupBy("c").agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("c") == F.col("cu"), F.col("w"))).alias("inside"))
    total = both.agg(F.sum("w").alias("t"))
    row = of.crossJoin(F.broadcast(total)).agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("t") - (F.col("degree") / F.col("t")) ** 2).alias("q")).first()
    return row["q"] or 0.0


def _moved(both: DataFrame, degree: DataFrame, total: float, label: DataFrame, turn: int) -> DataFrame:
    """(v, c): the labels after one round."""
    near = both.where("v <> u").join(label.select(F.col("v").alias("u"), "c"), "u").groupBy("v", "c").agg(F.sum("w").alias("k"))
    tot = label.join(degree, "v").groupBy("c").agg(F.sum("degree").alias("tot"))
    own = label.select("v", F.col("c").alias("own")).join(degree, "v")
    # staying where one is may mean a community without a neighbour in it
    ways = near.union(label.select("v", "c", F.lit(0.0))).groupBy("v", "c").agg(F.sum("k").alias("k")).join(tot, "c").join(own, "v")
    rest = F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("degree")).otherwise(0.0)
    gain = F.round(F.col("k") - F.col("degree") * rest / F.lit(total), 9)
    judged = ways.select("v", "own", "c", gain.alias("gain"))
    best = judged.groupBy("v", "own").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"), F.max_by("c", F.struct(F.col("gain"), F.col("c") == F.col("own"))).alias("go"), F.max("gain").alias("gain"))
    mine = F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(2)) == 0
    return best.select("v", F.when(mine & (F.col("gain") > F.col("stay")), F.col("go")).otherwise(F.col("own")).alias("c"))


def communities(edges: DataFrame) -> DataFrame:
    """(v, community) of every vertex of the edges (a, b, w), w > 0; a community is
    named by its smallest vertex.  Edges with a null end or weight go."""
    kind = edges.schema["a"].dataType.simpleString()
    good = edges.where("a is not null and b is not null and w > 0").select("a", "b", F.col("w").cast("double").alias("w"))
    both = kept(_both(good))
    member = kept(both.select("v").distinct().select("v", F.col("v").alias("c")))
    if not both.limit(1).count():
        return both.sparkSession.createDataFrame([], f"v {kind}, community {kind}")
    turn = 0
    while True:
        degree = kept(both.groupBy("v").agg(F.sum("w").alias("degree")))
        total = degree.agg(F.sum("degree").alias("t")).first()["t"]
        label = best = kept(degree.select("v", F.col("v").alias("c")))
        most, idle, still = _quality(both, label), 0, 0
        for _ in range(ROUNDS):
            turn += 1
            after = kept(_moved(both, degree, total, label, turn))
            changed = after.join(label.withColumnRenamed("c", "old"), "v").where("c <> old").limit(1).count()
            label, still = after, 0 if changed else still + 1
            if still == 4:  # nobody of either half, in all likelihood, wants to move
                break
            if changed:
                now = _quality(both, label)
                idle = 0 if now > most + 1e-9 else idle + 1
                if now > most + 1e-9:
                    best, most = label, now
                if idle == PATIENCE:
                    break
        merged = best.where("v <> c").limit(1).count()
        if not merged:
            break
        member = kept(member.join(best.select(F.col("v").alias("c"), F.col("c").alias("to")), "c").select("v", F.col("to").alias("c")))
        ends = best.select(F.col("v").alias("u"), F.col("c").alias("cu"))
        # loops stand for what is inside; from both ends, they are there twice, as they should
        both = kept(both.join(best, "v").join(ends, "u").groupBy(F.col("c").alias("v"), F.col("cu").alias("u")).agg(F.sum("w").alias("w")))
    named = member.groupBy("c").agg(F.min("v").alias("community"))
    return member.join(named, "c").select("v", "community")
