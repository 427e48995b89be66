"""Paradigm grids: tables of words in which rows and columns are analogies.

Clusters that share no word can never stand in one grid, so grids are built
within connected components of clusters, each in one grouped map; within it,
clusters are tried in order of size and text, pass after pass, until none fits
any more, and then the next grid begins.  A component's clusters are held by one
task, and looked at about as often as their words gain a cell (``assemble``).
"""

from __future__ import annotations

import functools
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetrad.functions.solver import first_solution

Ratios = list[tuple[str, str]]


class Grid:
    """Cells by (line, place); the word's cell is the last it was put in."""

    def __init__(self, ratios: Ratios) -> None:
        self.cells: dict[tuple[int, int], str] = {}
        self.at: dict[str, tuple[int, int]] = {}
        self.shape = [2, len(ratios)]
        for line in (0, 1):
            for n, pair in enumerate(ratios):
                self.put(line, n, pair[line])

    def put(self, line: int, place: int, word: str) -> None:
        self.cells[line, place] = word
        self.at[word] = (line, place)

    def fit(self, ratios: Ratios) -> tuple[int, int | None, int | None] | None:
        """(axis, where the a words stand, where the b words stand) along which a
        cluster fits: a ratio with both words on one line or place, or two of its
        a words (or b words) on one; None stands for a new one."""
        seen: tuple[dict, dict] = ({}, {})
        for pair in ratios:
            spots = [self.at.get(w) for w in pair]
            if spots[0] and spots[1]:
                for axis in (0, 1):
                    if spots[0][axis] == spots[1][axis]:
                        return 1 - axis, spots[0][1 - axis], spots[1][1 - axis]
                continue
            for side in (0, 1):
                if not spots[side]:
                    continue
                for axis in (0, 1):
                    key = axis, spots[side][axis]
                    seen[side][key] = seen[side].get(key, 0) + 1
                    if seen[side][key] == 2:
                        where: list[int | None] = [None, None]
                        where[side] = key[1]
                        return axis, where[0], where[1]
        return None

    def insert(self, ratios: Ratios, axis: int, first: int | None, second: int | None) -> set[str]:
        """Put the ratios so that their a words share one line (axis 0) or place
        (axis 1), and their b words another; ratios without a word there get a
        new one across.  Gives the words that were put."""
        placed = set()
        known = 0 if first is not None else 1
        where = [first, second]
        if where[1 - known] is None:
            where[1 - known] = self.shape[axis]
            self.shape[axis] += 1
        for pair in ratios:
            spot = self.at.get(pair[known])
            if spot is None:
                across = self.shape[1 - axis]
                self.shape[1 - axis] += 1
                sides: tuple[int, ...] = (0, 1)
            elif spot[axis] == where[known]:
                across, sides = spot[1 - axis], (1 - known,)
            else:
                continue
            for side in sides:
                self.put(*((where[side], across) if axis == 0 else (across, where[side])), pair[side])
                placed.add(pair[side])
        return placed

    def saturation(self) -> float:
        return len(self.cells) / (self.shape[0] * self.shape[1])

    def copy(self) -> Grid:
        twin = Grid([])
        twin.cells, twin.at, twin.shape = dict(self.cells), dict(self.at), list(self.shape)
        return twin


def assemble(clusters: list[Ratios], saturation: float = 0.0) -> list[Grid]:
    """Grids of clusters in their order: pass after pass, each cluster that fits is
    put into the grid, until a pass puts none; then the next grid begins.

    Whether a cluster fits depends on where its words stand.  So a pass looks only
    at clusters that have a word which was put since they were looked at, and at
    those that fitted but left the grid too empty; what comes before the cluster
    that put the word waits for the next pass.  A cluster is looked at as often as
    its words are put, whatever the number of passes.
    """
    waiting: dict[str, list[int]] = {}
    for i, ratios in enumerate(clusters):
        for word in {w for pair in ratios for w in pair}:
            waiting.setdefault(word, []).append(i)
    left, grids = dict.fromkeys(range(len(clusters))), []
    while left:
        first = next(iter(left))
        del left[first]
        grid = Grid(clusters[first])
        grids.append(grid)
        about = lambda words: {i for w in words for i in waiting[w] if i in left}
        coming, rejected = about(grid.at), set()
        while coming:
            # of this pass, in order; ``queued`` are those that are in it
            now, queued, coming, changed = sorted(coming), set(coming), set(), False
            while now:
                i = heappop(now)
                rejected.discard(i)
                spot = grid.fit(clusters[i])
                if not spot:
                    continue
                trial = grid.copy() if saturation else grid
                placed = trial.insert(clusters[i], *spot)
                if saturation and trial.saturation() < saturation:
                    rejected.add(i)
                    continue
                grid.cells, grid.at, grid.shape, changed = trial.cells, trial.at, trial.shape, True
                del left[i]
                for j in about(placed):
                    if j < i:
                        coming.add(j)
                    elif j not in queued:
                        queued.add(j)
                        heappush(now, j)
            coming = coming | rejected if changed else set()
    return grids


def components(ratios: DataFrame, rounds: int = 50) -> DataFrame:
    """(cluster_id, component): clusters joined by common words, named by their
    smallest cluster id.  Labels spread over words until none changes."""
    member = kept(ratios.select("cluster_id", F.explode(F.array("a", "b")).alias("word")).distinct())
    label = member.select("cluster_id", F.col("cluster_id").alias("component")).distinct()
    for _ in range(rounds):
        by_word = member.join(label, "cluster_id").groupBy("word").agg(F.min("component").alias("component"))
        after = member.join(by_word, "word").groupBy("cluster_id").agg(F.min("component").alias("component"))
        # a label that is itself relabelled is followed at once, which halves long chains
        jump = after.select(F.col("cluster_id").alias("component"), F.col("component").alias("to"))
        after = after.join(jump, "component").select("cluster_id", F.col("to").alias("component"))
        after = kept(after)
        changed = after.alias("x").join(label.alias("y"), "cluster_id").where("x.component <> y.component").limit(1).count()
        label = after
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; a local master that has none gets a
    temporary one, a cluster without one is an error."""
    import re
    import tempfile

    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tetrad-"))
    return df.checkpoint()


def grids(ratios: DataFrame, saturation: float = 0.0, least: int = 2) -> DataFrame:
    """(grid_id, row, col, word) of the clusters of ``least`` ratios or more; a
    grid's id is its component and number."""
    size = ratios.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    # the rounds below read it again and again
    large = kept(ratios.join(size, "cluster_id").select("cluster_id", "a", "b"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"])
        found = []
        for _, own in rows.groupby("cluster_id"):
            pairs = list(zip(own["a"], own["b"], strict=True))
            found.append((-len(pairs), " :: ".join(f"{a} : {b}" for a, b in pairs), pairs))
        component = rows["component"].iloc[0]
        out = []
        for n, grid in enumerate(assemble([pairs for *_, pairs in sorted(found)], saturation)):
            out += [(f"{component}#{n}", r, c, w) for (r, c), w in sorted(grid.cells.items())]
        return pd.DataFrame(out, columns=["grid_id", "row", "col", "word"])

    labelled = large.join(components(large), "cluster_id").select("component", "cluster_id", "a", "b")
    return labelled.groupBy("component").applyInPandas(build, "grid_id string, row int, col int, word string")


def attributes(cells: DataFrame) -> DataFrame:
    """(grid_id, length, width, size, filled, saturation)."""
    out = cells.groupBy("grid_id").agg((F.max("row") + 1).alias("length"), (F.max("col") + 1).alias("width"), F.count("word").alias("filled"))
    return out.select("grid_id", "length", "width", (F.col("length") * F.col("width")).alias("size"), "filled", F.round(F.col("filled") / (F.col("length") * F.col("width")), 6).alias("saturation"))


def statistics(cells: DataFrame) -> DataFrame:
    """(size, saturation, freq)."""
    return attributes(cells).groupBy("size", "saturation").agg(F.count(F.lit(1)).alias("freq"))


def averages(cells: DataFrame) -> DataFrame:
    """(grids, size, saturation): how many grids, and their mean size and saturation."""
    return attributes(cells).agg(F.count(F.lit(1)).alias("grids"), F.round(F.avg("size"), 6).alias("size"), F.round(F.avg("saturation"), 6).alias("saturation"))


#: Rectangles of a hole that a round tries: one at first, then so many.
TRIED = 64


def predictable_words(cells: DataFrame) -> DataFrame:
    """(grid_id, row, col, word): words for the holes, each solved from the first
    rectangle of filled cells (by row, then place) that has a solution.

    Holes are gone through in rounds: each tries the next rectangles of those that
    have no word yet, and no hole ever holds more than ``TRIED`` of them.  Rounds
    end when every hole has a word, or no rectangle left.
    """
    hole = ["grid_id", "row", "col"]
    cells = kept(cells.select(*hole, "word"))
    shape = cells.groupBy("grid_id").agg(F.max("row").alias("r"), F.max("col").alias("c"))
    full = shape.select("grid_id", F.explode(F.sequence(F.lit(0), F.col("r"))).alias("row"), "c").select("grid_id", "row", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("col"))
    side = cells.select("grid_id", "row", F.col("col").alias("c2"), F.col("word").alias("b"))
    up = cells.select("grid_id", F.col("row").alias("r2"), "col", F.col("word").alias("c"))
    corner = cells.select("grid_id", F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("word").alias("a"))
    start = F.struct(F.lit(-1).alias("r2"), F.lit(-1).alias("c2"))
    waiting, found = full.join(cells, hole, "left_anti").withColumn("last", start), []
    tried = 1
    while True:
        boxes = waiting.join(side, ["grid_id", "row"]).join(up, ["grid_id", "col"]).join(corner, ["grid_id", "r2", "c2"])
        later = boxes.where(F.struct("r2", "c2") > F.col("last"))
        order = Window.partitionBy(*hole).orderBy("r2", "c2")
        taken = later.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= tried)
        held = F.array_sort(F.collect_list(F.struct("r2", "c2", "a", "b", "c")))
        each = taken.groupBy(*hole).agg(held.alias("boxes"), F.max(F.struct("r2", "c2")).alias("last"))
        solved = each.select(*hole, "last", F.size("boxes").alias("n"), first_solution(F.transform("boxes", lambda x: F.array(x["a"], x["b"], x["c"]))).alias("word"))
        solved = kept(solved)
        found.append(solved.where("word is not null").select(*hole, "word"))
        # a hole that has had fewer than it could take has no rectangle left
        waiting = solved.where((F.col("n") == tried) & F.col("word").isNull()).select(*hole, "last")
        tried = TRIED
        if not waiting.limit(1).count():
            return functools.reduce(DataFrame.union, found)
