"""Operators over ordered rows: numbering, runs, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str = "n") -> DataFrame:
    """Rows numbered from 0 within their group."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def run_blocks(rows: DataFrame, value: str, order: str, group: list[str] | None = None) -> DataFrame:
    """(group, value, first, last, n): maximal runs of equal values in order."""
    keys = group or []
    ordered = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(order) if keys else Window.orderBy(order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(ordered)), 0).otherwise(1)
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(running))
    return marked.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def forward_filled(rows: DataFrame, column: str, order: str, group: list[str]) -> DataFrame:
    """Nulls replaced by the last value before them in their group."""
    above = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(above))


def first_n(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; tasks drop what cannot be among them before groups meet."""
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return placed.where(F.col("_n") <= n).drop("_n")


def hashed_order(*columns: str, seed: int = 0) -> F.Column:
    """An order by md5 of the columns' text, the same in every engine."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def sample(rows: DataFrame, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, by a hash of their columns."""
    return rows.orderBy(hashed_order(*columns, seed=seed), *columns).limit(n)


def sample_each(rows: DataFrame, group: list[str], columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows of each group."""
    picked = F.row_number().over(Window.partitionBy(*group).orderBy(hashed_order(*columns, seed=seed), *columns))
    return rows.withColumn("_n", picked).where(F.col("_n") <= n).drop("_n")


def sample_with_replacement(rows: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """n draws, each row as often as it is drawn: draw k takes the row of number hash(k) mod count."""
    count = rows.count()
    if not count:
        return rows.select(column)
    draws = rows.sparkSession.range(n).select(F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "id", F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint"), F.lit(count)).alias("_n"))
    # rows are numbered within ranges, and ranges by how many rows are before them
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(column).repartitionByRange(spread, column).sortWithinPartitions(column).select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")).persist()
    shift, before = [], 0
    for r in sorted(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).collect(), key=lambda r: r["_part"]):  # one row a partition
        shift.append((r["_part"], r["first"] - before))
        before += r["n"]
    known = rows.sparkSession.createDataFrame(shift, "_part int, _shift long")
    order = dealt.join(F.broadcast(known), "_part").select(column, (F.col("_id") - F.col("_shift")).alias("_n"))
    return draws.join(order, "_n").select(column)


def split(rows: DataFrame, columns: list[str], share: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds ``part``: 'train' for that share of the rows by hash, else 'test'."""
    bucket = F.pmod(F.conv(F.substring(hashed_order(*columns, seed=seed), 1, 8), 16, 10).cast("bigint"), F.lit(1000))
    return rows.withColumn("part", F.when(bucket < int(share * 1000), "train").otherwise("test"))
