"""Rule trees of languages, as (lang, path, leaf) rows, and how much they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(trees: DataFrame, lang: str = "lang", tree: str = "tree") -> DataFrame:
    """(lang, path, leaf) of JSON trees as text, level by level until all are
    leaves.  A tree is a rule set of a language, so a level is small; each is
    looked at before the next one is unfolded."""
    inner = T.MapType(T.StringType(), T.StringType())
    now = trees.select(F.col(lang).alias("lang"), F.array().cast("array<string>").alias("path"), F.col(tree).alias("node"))
    out = None
    while True:
        children = F.from_json("node", inner)
        is_tree = children.isNotNull() & F.trim("node").startswith("{")
        ends = now.where(~F.coalesce(is_tree, F.lit(False))).select("lang", "path", F.col("node").alias("leaf"))
        out = ends if out is None else out.union(ends)
        now = now.where(is_tree).select("lang", "path", F.explode(children).alias("k", "node")).select("lang", F.concat("path", F.array("k")).alias("path"), "node")
        if now.isEmpty():
            return out


def shared_leaves(one: DataFrame, other: DataFrame) -> DataFrame:
    """(path, leaf, marked): the first tree's leaves, and whether any leaf of the
    other whose path is part of theirs, or the other way round, has one of their
    alternatives.  The trees are rule sets of a language: some hundreds of rows."""
    left = one.select("path", "leaf").distinct()
    right = other.select(F.col("path").alias("path2"), F.col("leaf").alias("leaf2")).distinct()
    within = (F.size(F.array_except("path", "path2")) == 0) | (F.size(F.array_except("path2", "path")) == 0)
    split = lambda c: F.split(c, r"\|")
    hits = left.join(right, within & F.arrays_overlap(split("leaf"), split("leaf2"))).select("path", "leaf").distinct().withColumn("marked", F.lit(True))
    return left.join(hits, ["path", "leaf"], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))


def similarity(one: DataFrame, other: DataFrame) -> DataFrame:
    """(marked, total, percent) of the first tree's leaves."""
    counted = shared_leaves(one, other).agg(F.count_if("marked").alias("marked"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("percent", F.round(100 * F.col("marked") / F.col("total")).cast("long"))


def assigned(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Leaves with the changes' leaf where the path is in both."""
    return rows.join(changes.withColumnRenamed("leaf", "_leaf"), ["lang", "path"], "left").select("lang", "path", F.coalesce("_leaf", "leaf").alias("leaf"))


def rendered(rows: DataFrame) -> DataFrame:
    """(lang, path, value) lines of leaves, as a page or a form shows them."""
    return rows.select("lang", F.array_join("path", "/").alias("path"), F.concat(F.array_join("path", " > "), F.lit(" = "), "leaf").alias("value"))
