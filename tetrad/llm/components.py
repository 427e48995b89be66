"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.llm.shared import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, label) for every id that has an edge; label is the component's smallest id.

    ``edges`` has columns a and b (long).  Each round links every node's larger
    neighbours to its smallest neighbour, then its smaller ones; both keep the
    components, and rounds end when nothing changes, after about the logarithm
    of the number of nodes.  A node of many neighbours is only ever aggregated
    (min), joined on and never gathered in one place; its rows in a join are one
    skewed key against one row, which adaptive execution splits over tasks.
    """
    # every edge from its larger to its smaller end
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(smallest.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, "edges")
        # done when every node has one smaller end, which itself has none
        again = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        chained = again or after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        now = after
        if not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).union(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
