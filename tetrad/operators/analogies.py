"""Analogies as rows (a, b, c, d): from clusters, from tagged triples, and their
equivalent and negative forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrad.functions.solver import solve_analogy
from tetrad.functions.strings import characters_balance, distances_balance, trivial_analogy
from tetrad.operators.windows import first_n, numbered

#: Orders of a, b, c, d that hold when one of them holds.
EQUIVALENT = ("abcd", "cdab", "cadb", "dbca", "dcba", "badc", "bdac", "acbd")
#: Orders that do not.
NEGATIVE = ("bacd", "cbad", "aacd")
#: Pairs that one class of tags may give, about.
PAIRS = 1_000_000
#: Cells of a band's width, and the rows of a cell at most.
CELLS, WIDTH = 4, 1000


def of_clusters(ratios: DataFrame, check: bool = True) -> DataFrame:
    """(cluster_id, a, b, c, d): unordered pairs of ratios of a cluster, those
    that are valid and not trivial."""
    x, y = ratios.alias("x"), ratios.alias("y")
    pairs = x.join(y, (F.col("x.cluster_id") == F.col("y.cluster_id")) & (F.struct("x.a", "x.b") < F.struct("y.a", "y.b")))
    quads = pairs.select(F.col("x.cluster_id").alias("cluster_id"), F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.a").alias("c"), F.col("y.b").alias("d"))
    quads = quads.where(~trivial_analogy("a", "b", "c", "d") & characters_balance("a", "b", "c", "d"))
    return quads.where(distances_balance("a", "b", "c", "d")) if check else quads


def class_pairs(rows: DataFrame, tag: str, order: str, pairs: int | None = PAIRS) -> DataFrame:
    """(tag, i, j): row numbers of the same tag with i <= j < i + k, where k makes
    about ``pairs`` pairs of the tag's n rows: an equi-join of cells of a band.
    Without ``pairs``, all i <= j of the tag."""
    x, y = _band(rows, tag, order, pairs)
    return _met(x, y, tag).select(F.col(f"x.{tag}").alias(tag), F.col(f"x.{order}").alias("i"), F.col(f"y.{order}").alias("j"))


def _band(rows: DataFrame, tag: str, order: str, pairs: int | None, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with their place p, the band's width k and the cell of their place; and
    rows once for each cell that holds places less than k before theirs.  A cell is
    a CELLS-th of k, so rows meet about k others, whatever their class's size, and
    of WIDTH rows at most, so a wide band is dealt to many tasks."""
    counts = rows.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(rows.select(tag, order, *carried), [tag], [order], "p").join(counts, tag)
    k = F.col("n") if pairs is None else F.least(F.floor(F.lit(pairs) / F.col("n")), F.col("n"))
    placed = placed.withColumn("k", k).where("k > 0").withColumn("w", F.least(F.ceil(F.col("k") / CELLS), F.lit(WIDTH)))
    first, last = (F.floor(F.greatest(p, F.lit(0)) / F.col("w")) for p in (F.col("p") - F.col("k") + 1, F.col("p")))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few rows make many pairs: without a number, small partitions would be put together
    x = placed.withColumn("cell", last).drop("n", "w").repartition(spread, tag, "cell")
    y = placed.withColumn("cell", F.explode(F.sequence(first, last))).drop("n", "w", "k").repartition(spread, tag, "cell")
    return x.alias("x"), y.alias("y")


def _met(x: DataFrame, y: DataFrame, tag: str) -> DataFrame:
    same = (F.col(f"x.{tag}") == F.col(f"y.{tag}")) & (F.col("x.cell") == F.col("y.cell"))
    return x.join(y, same & (F.col("y.p") >= F.col("x.p")) & (F.col("y.p") < F.col("x.p") + F.col("x.k")))


def unique(rows: DataFrame, key: str) -> bool:
    """Whether no two rows have the same key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def of_classes(rows: DataFrame, tag: str, key: str, lemma: str, form: str, pairs: int | None = PAIRS, distinct: bool = False) -> DataFrame:
    """(i, j, a, b, c, d) of ``class_pairs``; rows of distinct keys carry their
    lemmas and forms with them, so that pairs need not be joined with rows again."""
    if not distinct:
        return of_pairs(class_pairs(rows, tag, key, pairs), rows, key, lemma, form)
    x, y = _band(rows, tag, key, pairs, (lemma, form))
    taken = [F.col(f"{side}.{c}").alias(name) for side, c, name in (("x", key, "i"), ("y", key, "j"), ("x", lemma, "a"), ("x", form, "b"), ("y", lemma, "c"), ("y", form, "d"))]
    return _met(x.where(F.col(key).isNotNull()), y.where(F.col(key).isNotNull()), tag).select(*taken)


def of_pairs(pairs: DataFrame, rows: DataFrame, key: str, lemma: str, form: str) -> DataFrame:
    """(i, j, a, b, c, d) with the lemma and form of both rows."""
    first = rows.select(F.col(key).alias("i"), F.col(lemma).alias("a"), F.col(form).alias("b"))
    second = rows.select(F.col(key).alias("j"), F.col(lemma).alias("c"), F.col(form).alias("d"))
    return pairs.join(first, "i").join(second, "j").select("i", "j", "a", "b", "c", "d")


def _orders(quads: DataFrame, orders: tuple[str, ...], name: str) -> DataFrame:
    others = [c for c in quads.columns if c not in ("a", "b", "c", "d", name)]
    made = F.array(*[F.struct(F.lit(o).alias(name), *[F.col(o[k]).alias(x) for k, x in enumerate("abcd")]) for o in orders])
    return quads.select(*others, F.explode(made).alias("q")).select(*others, "q.*")


def enriched(quads: DataFrame) -> DataFrame:
    """The eight equivalent forms of each analogy, with ``form``."""
    return _orders(quads, EQUIVALENT, "form")


def negatives(quads: DataFrame, skip_degenerate: bool = True) -> DataFrame:
    """The three negative forms, with ``form``; of a : a :: c : d none."""
    kept = quads.where("not (a = b or c = d)") if skip_degenerate else quads
    return _orders(kept, NEGATIVE, "form")


def balanced_negatives(quads: DataFrame, keys: list[str], n: int = 8, all_forms: bool = True, seed: int = 0, distinct: bool = False) -> DataFrame:
    """n negatives of each analogy: of all 24 (three for each equivalent form),
    or, without all_forms, the three of the form acbd.  Each row picks its own n
    before any are made; rows of the same keys meet after that, and with
    ``distinct`` (no two rows have the same keys) not at all."""
    if not all_forms:
        return negatives(_orders(quads, ("acbd",), "form").drop("form"))
    # a mark is the hash that sample_each orders by, and what it is the hash of; one lambda for all
    # 24, since a method of 24 hashes is too large for the JVM to compile
    tail = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    names = lambda across: F.array(*[F.lit(f"{of}|{form}|") for of in EQUIVALENT for form in NEGATIVE if ({of[0], of[1]} in ({"a", "c"}, {"b", "d"})) == across])
    along, across = ((F.col(w) != F.col(x)) & (F.col(y) != F.col(z)) for w, x, y, z in ("abcd", "acbd"))
    none = F.array().cast("array<string>")
    held = F.concat(F.when(along, names(False)).otherwise(none), F.when(across, names(True)).otherwise(none))
    marks = F.transform(held, lambda x: F.concat(F.md5(F.concat(x, F.col("_tail"))), x))
    others = [c for c in quads.columns if c not in ("a", "b", "c", "d")]
    picked = quads.withColumn("_tail", tail).withColumn("_mark", F.explode(F.slice(F.sort_array(marks), 1, n)))
    if not distinct:
        picked = first_n(picked, keys, ["_mark"], n)
    picked = picked.select(*others, "a", "b", "c", "d", F.substring("_mark", 33, 4).alias("of"), F.substring("_mark", 38, 4).alias("form"))
    letter = lambda k: F.substring("of", F.instr(F.lit("abcd"), F.substring("form", k, 1)), F.lit(1))
    taken = lambda x: F.when(x == "a", F.col("a")).when(x == "b", F.col("b")).when(x == "c", F.col("c")).otherwise(F.col("d"))
    return picked.select(*others, "of", "form", *[taken(letter(k + 1)).alias(x) for k, x in enumerate("abcd")])


def random_equations(spark: SparkSession, n: int, length: int = 8, letters: int = 8, seed: int = 0) -> DataFrame:
    """(id, a, b, c): equations of random words of 1 to ``length`` of that many
    letters, by hashes of their numbers."""
    digit = lambda column, *salt: F.conv(F.substring(F.md5(F.concat_ws("|", column, *[F.lit(str(x)) for x in (*salt, seed)])), 1, 8), 16, 10).cast("bigint")

    def word(name: str) -> F.Column:
        size = F.pmod(digit("id", name), F.lit(length)) + 1
        drawn = [F.chr(F.lit(97) + F.pmod(digit("id", name, k), F.lit(letters))) for k in range(length)]
        return F.array_join(F.slice(F.array(*drawn), 1, size.cast("int")), "")

    return spark.range(n).select("id", *[word(x).alias(x) for x in "abc"])


def success(equations: DataFrame) -> DataFrame:
    """(equations, solved, rate) of (a, b, c)."""
    done = equations.withColumn("_d", solve_analogy("a", "b", "c"))
    out = done.agg(F.count(F.lit(1)).alias("equations"), F.count("_d").alias("solved"))
    return out.withColumn("rate", F.round(F.col("solved") / F.col("equations"), 6))
