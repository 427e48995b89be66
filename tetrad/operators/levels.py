"""Vectors as a prefix tree, and clusters found level by level on its nodes.

Vectors are numbered in their order; a node of level k is the range of the
vectors whose first k components are the same, and is known by its first
vector.  Pairs of nodes are refined from level to level: a pair's children are
paired with each other, and those of one group whose new components differ
alike form a group of the next level.  A group in which only one pair of
vectors is left is dropped with its pairs, so what is expanded on the last
levels is less than all pairs of vectors.

Rare components come first: they make few nodes, so groups are told apart while
there are few pairs of nodes.  At the level where these are a small share of all
pairs, groups are dealt to tasks; from there on a group's pairs are expanded,
told apart and counted where they are, and the pairs of vectors, which are
nearly all of the work, are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tetrad.operators.grids import kept

#: Up to so many vectors, counted first, a level's nodes are sent to all tasks; beyond, they are joined.
BROADCAST = 100_000
#: Groups are dealt at the last level whose pairs of nodes are at most this share of all pairs.
DEALT = 0.05
#: A level is refined when the tree has grown by so much since the last one, before groups are dealt and after.
GROWTH = 4.0, 1.4
#: Pairs of vectors of a task, about.
PAIRS = 1_000_000


def ranked(rows: DataFrame, order: str, out: str) -> DataFrame:
    """Rows numbered from 0 in an order, which no task sees as a whole: they are
    dealt by ranges, and numbered within each from what is in those before it."""
    spark = rows.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(spread, order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")).persist()
    shift, before = [], 0
    for r in sorted(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).collect(), key=lambda r: r["_part"]):  # one row a partition
        shift.append((r["_part"], r["first"] - before))
        before += r["n"]
    known = spark.createDataFrame(shift, "_part int, _shift long")
    return dealt.join(F.broadcast(known), "_part").select(*rows.columns, (F.col("_id") - F.col("_shift")).alias(out))


def _name(vector: F.Column, level: F.Column) -> F.Column:
    """Two 64-bit hashes of a prefix, which stand for it."""
    prefix = F.slice(vector, F.lit(1), level)
    return F.struct(F.xxhash64(prefix).alias("x"), F.xxhash64(F.lit("prefix"), prefix).alias("y"))


def nodes(vectors: DataFrame) -> DataFrame:
    """(level, start, stop, size, value, empty_rest): the tree of the distinct
    vectors (v), which all have the same number of components.

    Level 0 is the root, with value 0; ``start`` and ``stop`` number the vectors
    of a node, ``value`` is their component on its level, and ``empty_rest`` says
    whether it is one vector with nothing but zeros from there on.
    """
    numbered = ranked(vectors.select("v").distinct(), "v", "rank")
    levels = numbered.select("rank", "v", F.explode(F.sequence(F.lit(0), F.size("v"))).alias("level"))
    value = F.when(F.col("level") == 0, 0).otherwise(F.get("v", F.col("level") - 1))
    rest = F.forall(F.slice("v", F.greatest(F.col("level"), F.lit(1)), F.size("v") + 1), lambda x: x == 0)
    placed = levels.select("level", "rank", value.alias("value"), rest.alias("rest"), _name(F.col("v"), F.col("level")).alias("prefix"))
    found = placed.groupBy("level", "prefix").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("size"), F.first("value").alias("value"), F.bool_and("rest").alias("rest"))
    return found.select("level", "start", (F.col("start") + F.col("size")).alias("stop"), "size", "value", ((F.col("size") == 1) & F.col("rest")).alias("empty_rest"))


def linked(tree: DataFrame) -> DataFrame:
    """A tree's nodes, numbered by level and place, with the numbers of their first
    and last child; both are -1 on the last level."""
    placed = ranked(tree.select("*", F.struct("level", "start").alias("_at")), "_at", "number").drop("_at")
    child = lambda of, name: placed.select((F.col("level") - 1).alias("level"), F.col(of), F.col("number").alias(name))
    both = placed.join(child("start", "first_child"), ["level", "start"], "left").join(child("stop", "last_child"), ["level", "stop"], "left")
    return both.na.fill(-1, ["first_child", "last_child"]).select("number", "level", "start", "stop", "size", "value", "empty_rest", "first_child", "last_child")


@dataclass(frozen=True)
class Levels:
    """Clusters by levels, and how they were found."""

    #: (r, s, and the columns of ``groups``): pairs of numbered vectors by groups of equal difference.
    pairs: DataFrame
    #: (word, v, rank): the vectors as they are numbered.
    numbered: DataFrame
    #: For each refined level, how many components it has taken in, and the pairs of nodes that were expanded at it.
    plan: list[tuple[int, DataFrame]]

    groups = ("g1", "g2", "d1", "d2")


def _places(vectors: DataFrame) -> list[int]:
    """The components' places, the rarest component first."""
    one = vectors.select(F.size("v").alias("n")).first()
    if one is None or not one["n"]:
        return []
    held = vectors.agg(*[F.count_if(F.get("v", F.lit(i)) != 0) for i in range(one["n"])]).first()
    return sorted(range(one["n"]), key=lambda i: (held[i], i))


def _cuts(vectors: DataFrame, dims: int) -> tuple[list[int], int]:
    """The levels to refine, of which the last is that of the vectors, and the one at which groups are dealt."""
    prefixes = vectors.select("v", F.explode(F.sequence(F.lit(1), F.lit(dims))).alias("level")).select("level", _name(F.col("v"), F.col("level")).alias("p"))
    nodes = {r["level"]: r["count"] for r in prefixes.distinct().groupBy("level").count().collect()}  # one row a level
    few = [k for k in range(1, dims) if nodes[k] ** 2 <= DEALT * nodes[dims] ** 2]
    dealt = few[-1] if few else dims
    cuts, last = [], 1
    for level in range(1, dims):
        grown, wanted = nodes[level] / last, GROWTH[level > dealt]
        if level == dealt or (grown >= wanted and (nodes[dealt] if level < dealt else nodes[dims]) >= wanted * nodes[level]):
            cuts.append(level)
            last = nodes[level]
    return [*cuts, dims], dealt


def _signature(vector: Column, seed: int) -> Column:
    """A sum of components, each times a large number of its place: the signature
    of a difference is the difference of the signatures."""
    factor = lambda i: F.pmod(F.xxhash64(F.lit(seed), i), F.lit(1 << 40))
    return F.aggregate(F.transform(vector, lambda x, i: x * factor(i)), F.lit(0).cast("long"), lambda s, x: s + x)


def refine(vectors: DataFrame, least: int = 2) -> Levels:
    """Pairs of words (word, v) by groups whose vectors differ alike; vectors are
    distinct.  A group's surface is how many pairs of vectors its pairs of nodes
    hold; groups with a surface below ``least`` are not refined further, and those
    of the last level stay to be counted.

    Two different differences are taken for equal by a chance of about 2**-80.
    """
    spark = vectors.sparkSession
    # one row a vector, read again on every level: the plan of a level begins here
    vectors = kept(vectors.select("word", "v"))
    order = _places(vectors)
    rare = F.array(*[F.get("v", F.lit(i)) for i in order]) if order else F.col("v")
    numbered = kept(ranked(vectors.select("word", "v", rare.alias("u")), "u", "rank"))
    words, n = numbered.select("word", "v", "rank"), numbered.count()
    groups = ", ".join(f"{c} long" for c in Levels.groups)
    if not order or n < 2:
        return Levels(spark.createDataFrame([], f"r long, s long, {groups}"), words, [])
    small = n <= BROADCAST
    side = F.broadcast if small else (lambda df: df)
    cuts, dealt = _cuts(numbered.select(F.col("u").alias("v")), len(order))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * n // 2 // PAIRS)
    now = spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("r", "s", *Levels.groups)])
    plan: list[tuple[int, DataFrame]] = []
    before = 0
    for level in cuts:
        # a node is known by its first vector, on this level and on the last one
        node = lambda k: F.min("rank").over(Window.partitionBy(_name(F.col("u"), F.lit(k)))) if k else F.lit(0).cast("long")
        new = F.slice("u", before + 1, level - before)
        part = numbered.select(node(level).alias("node"), node(before).alias("up"), _signature(new, 1).alias("s1"), _signature(new, 2).alias("s2"))
        children = part.groupBy("up", "node", "s1", "s2").agg(F.count(F.lit(1)).alias("w"))
        children = kept(children.coalesce(1) if small else children)
        one, other = (side(children.select(*[F.col(c).alias(f"{c}_{x}") for c in children.columns])) for x in "xy")
        met = now.join(one, F.col("r") == F.col("up_x")).join(other, (F.col("s") == F.col("up_y")) & (F.col("node_x") <= F.col("node_y")))
        surface = F.when(F.col("node_x") == F.col("node_y"), F.expr("w_x * (w_x - 1) div 2")).otherwise(F.col("w_x") * F.col("w_y"))
        # signatures of earlier levels are mixed in: a group is one difference of all components so far
        mixed = lambda i: F.xxhash64(F.col(f"d{i}"), F.lit(level), F.col(f"s{i}_x") - F.col(f"s{i}_y")).alias(f"d{i}")
        found = met.select(F.col("node_x").alias("r"), F.col("node_y").alias("s"), "g1", "g2", mixed(1), mixed(2), surface.alias("surface")).where("surface > 0")
        plan.append((level, found))
        if level == dealt:
            found = found.withColumns({"g1": F.col("d1"), "g2": F.col("d2")}).repartition(parts, "g1", "g2")
        if level < len(order):
            total = F.sum("surface").over(Window.partitionBy(*Levels.groups))
            found = found.withColumn("total", total).where(F.col("total") >= least)
        now = found.select("r", "s", *Levels.groups)
        before = level
    return Levels(now, words, plan)


def clusters(vectors: DataFrame, least: int = 2) -> DataFrame:
    """(cluster_id, size, a, b): the clusters of at least so many ratios, as raw
    clusters are, found by levels."""
    found = refine(vectors, least)
    size = F.count(F.lit(1)).over(Window.partitionBy(*Levels.groups))
    counted = found.pairs.select("r", "s", size.alias("size")).where(F.col("size") >= least)
    side = lambda at, word, v: found.numbered.select(F.col("rank").alias(at), F.col("word").alias(word), F.col("v").alias(v))
    spoken = counted.join(side("r", "x", "vx"), "r").join(side("s", "y", "vy"), "s")
    # ratios stand in the order of the vectors as they are, which is the same for all of a cluster
    turned = F.col("vx") > F.col("vy")
    either = lambda p, q: F.when(turned, F.col(p)).otherwise(F.col(q))
    apart = F.zip_with(either("vy", "vx"), either("vx", "vy"), lambda p, q: p - q)
    return spoken.select(F.array_join(apart, ",").alias("cluster_id"), "size", either("y", "x").alias("a"), either("x", "y").alias("b"))


def sizes(vectors: DataFrame, least: int = 2) -> DataFrame:
    """(size, freq): how many clusters have so many ratios, found by levels."""
    counted = refine(vectors, least).pairs.groupBy(*Levels.groups).agg(F.count(F.lit(1)).alias("size"))
    return counted.where(F.col("size") >= least).groupBy("size").agg(F.count(F.lit(1)).alias("freq"))


def report(vectors: DataFrame, least: int = 2) -> DataFrame:
    """(level, expanded, surface): for each refined level, how many components it
    has taken in, the pairs of nodes that were expanded there, and how many pairs
    of vectors these hold."""
    counted = [pairs.agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("expanded"), F.coalesce(F.sum("surface"), F.lit(0)).alias("surface")) for level, pairs in refine(vectors, least).plan]
    out = vectors.sparkSession.createDataFrame([], "level int, expanded long, surface long")
    for one in counted:
        out = out.union(one)
    return out
