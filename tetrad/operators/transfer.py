"""How well analogies of one language are judged by another language's scorer,
and the languages' dendrogram and communities.

What does not depend on the model is found once a quad, before models and quads
meet: its letters, whether its characters balance, and how far distances are
apart.  For each pair of a model's and a data's language it is known which
letters of the data the model lacks.  A scorer is a Column function of these
columns, and of what the model has besides, to a probability.  The default
believes what balances and is spelled with letters that it knows.  ``train``
fits a logistic regression for each language in its place, and
``tetrad.operators.neural`` a network.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrad.functions.strings import characters_balance, chars, lcs_distance_arrow

if TYPE_CHECKING:
    from pyspark.ml.classification import LogisticRegressionModel as Model

#: From the columns of a quad, of its language's ``missing`` letters and of a model to a probability.
Scorer = Callable[[], Column]


def rule_scorer() -> Column:
    """0.9 for balanced characters all known to the model's language, 0.4 with
    unknown ones, else 0.1."""
    return F.when(F.col("balance") == 1, F.when(F.arrays_overlap("letters", "missing"), 0.4).otherwise(0.9)).otherwise(0.1)


def accuracy(probability: str, truth: str, least: float = 0.5, only: Column | bool = True) -> Column:
    """Share of rows whose probability is on the right side, of those that ``only`` takes."""
    right = ((F.col(probability) > least) == F.col(truth)).cast("double")
    return F.avg(right if only is True else F.when(only, right))


def looked_at(quads: DataFrame) -> DataFrame:
    """Quads with their distinct letters, and 1 or 0 for whether their characters balance."""
    letters = F.array_distinct(F.concat(*[chars(x) for x in "abcd"]))
    return quads.withColumns({"letters": letters, "balance": characters_balance("a", "b", "c", "d").cast("double")})


FEATURES = ("balance", "lengths", "across", "along", "known")


def measured(quads: DataFrame) -> DataFrame:
    """Quads with what a learned scorer looks at in every language: whether the
    characters balance, and how far the lengths and the distances of a proportion
    are apart."""
    lengths = F.abs(F.length("a") + F.length("d") - F.length("b") - F.length("c")).cast("double")
    apart = lambda w, x, y, z: F.abs(lcs_distance_arrow(w, x) - lcs_distance_arrow(y, z)).cast("double")
    return looked_at(quads).withColumns({"lengths": lengths, "across": apart("a", "b", "c", "d"), "along": apart("a", "c", "b", "d")})


def known_share() -> Column:
    """The share of a quad's letters that the model's language has."""
    return (F.size(F.array_except("letters", "missing")) / F.greatest(F.size("letters"), F.lit(1))).cast("double")


def train(quads: DataFrame, regularisation: float = 0.01) -> dict[str, Model]:
    """A logistic regression for each language on its own measured quads (lang,
    a, b, c, d, valid), whose letters it all knows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = quads.select("lang", F.col("valid").cast("double").alias("label"), *FEATURES[:-1], F.lit(1.0).alias("known"))
    # equal rows are one of a weight, so what is gone through again and again is small
    rows = rows.groupBy("lang", "label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("lang", "label", "weight", "features").persist()
    learner = LogisticRegression(regParam=regularisation, standardization=False, weightCol="weight", maxIter=50)
    out = {r["lang"]: learner.fit(rows.where(F.col("lang") == r["lang"]).coalesce(8)) for r in rows.select("lang").distinct().orderBy("lang").collect()}  # one row a language
    rows.unpersist()
    return out


def save(models: dict[str, Model], folder: str) -> None:
    """The learned models, each in a folder of its language's name."""
    for lang, model in models.items():
        model.write().overwrite().save(f"{folder}/{lang}")


def load(languages: list[str], folder: str) -> dict[str, Model]:
    from pyspark.ml.classification import LogisticRegressionModel

    return {lang: LogisticRegressionModel.load(f"{folder}/{lang}") for lang in languages}


def weights(spark: SparkSession, models: dict[str, Model]) -> DataFrame:
    """(lang, weights, intercept) of the learned models."""
    rows = [(lang, [float(x) for x in m.coefficients], float(m.intercept)) for lang, m in models.items()]
    return spark.createDataFrame(rows, "lang string, weights array<double>, intercept double")


def learned() -> Column:
    """Probability of a measured quad by a learned model (columns weights and intercept)."""
    values = [*[F.col(x) for x in FEATURES[:-1]], known_share()]
    score = sum((F.get("weights", F.lit(i)) * x for i, x in enumerate(values)), start=F.col("intercept"))
    return 1 / (1 + F.exp(-score))


#: Pairs of languages that go to every task at most; more of them meet in a plain join.
LANGUAGES = 10_000
MODES = ("full", "partial")


def meetings(models: DataFrame, quads: DataFrame, mode: str) -> DataFrame:
    """(model_lang, data_lang, missing, and what the models have): each model with
    each language of the quads, and the letters of that language's quads that the
    model's alphabet lacks; in mode 'partial' none, as the data's own alphabet is
    taken.  Both sides have one row a language."""
    if mode not in MODES:
        raise ValueError("mode is full or partial")
    spelled = quads.select(F.col("lang").alias("data_lang"), F.explode("letters").alias("ch")).distinct().groupBy("data_lang").agg(F.collect_set("ch").alias("_letters"))
    languages = quads.select(F.col("lang").alias("data_lang")).distinct().join(spelled, "data_lang", "left")
    of = models.withColumnsRenamed({"lang": "model_lang", "alphabet": "_alphabet"})
    none = F.array().cast("array<string>")
    missing = F.coalesce(F.array_except("_letters", "_alphabet"), none) if mode == "full" else none
    return of.crossJoin(languages).withColumn("missing", missing).drop("_letters", "_alphabet")


def matrix(models: DataFrame, quads: DataFrame, scorer: Scorer = rule_scorer, mode: str = "full") -> DataFrame:
    """(model_lang, data_lang, acc_valid, acc_invalid, acc_raw): models (lang,
    alphabet, and what else the scorer takes) against quads (lang, a, b, c, d,
    valid, and what ``looked_at`` or ``measured`` adds).  A quad meets the models
    in an equi-join on its language; the pairs of languages are counted before
    they go to all tasks.
    """
    pairs = meetings(models, quads, mode)
    few = pairs.limit(LANGUAGES + 1).count() <= LANGUAGES
    scored = quads.withColumnRenamed("lang", "data_lang").join(F.broadcast(pairs) if few else pairs, "data_lang").withColumn("p", scorer())
    means = {"acc_valid": F.col("valid"), "acc_invalid": ~F.col("valid"), "acc_raw": True}
    return scored.groupBy("model_lang", "data_lang").agg(*[F.round(accuracy("p", "valid", only=x), 6).alias(n) for n, x in means.items()])


def look_up(long: DataFrame, model_lang: str, data_lang: str) -> DataFrame:
    """One pair's row of a matrix."""
    return long.where((F.col("model_lang") == model_lang) & (F.col("data_lang") == data_lang))


def pivoted(long: DataFrame, languages: list[str], value: str = "acc_invalid") -> DataFrame:
    """One column a data language."""
    return long.groupBy("model_lang").pivot("data_lang", languages).agg(F.first(value))


def adjacency(long: DataFrame, value: str = "acc_invalid") -> DataFrame:
    """(l1, l2, weight): both directions' mean, each pair once."""
    pair = long.where("model_lang <> data_lang").select(F.least("model_lang", "data_lang").alias("l1"), F.greatest("model_lang", "data_lang").alias("l2"), value)
    return pair.groupBy("l1", "l2").agg(F.round(F.avg(value), 6).alias("weight"))


def _collected(edges: DataFrame, most: int = 20_000) -> list[tuple[str, str, float]]:
    """A language adjacency on the driver; anything larger is a mistake."""
    rows = edges.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many pairs for a matrix of languages")
    return [(r["l1"], r["l2"], r["weight"]) for r in rows]


def _square(edges: list[tuple[str, str, float]]) -> tuple[list[str], np.ndarray]:
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {x: i for i, x in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for a, b, w in edges:
        out[at[a], at[b]] = out[at[b], at[a]] = w
    return names, out


def ward(points: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (first, second, height, size) of Ward's method on the rows."""
    centre = {i: points[i].astype(float) for i in range(len(points))}
    size = dict.fromkeys(centre, 1)
    out = []
    while len(centre) > 1:
        ids = sorted(centre)
        cost = {(i, j): float(np.sqrt(2 * size[i] * size[j] / (size[i] + size[j]) * ((centre[i] - centre[j]) ** 2).sum())) for n, i in enumerate(ids) for j in ids[n + 1 :]}
        i, j = min(cost, key=lambda k: (round(cost[k], 12), k))
        new, n = len(points) + len(out), size[i] + size[j]
        centre[new] = (size[i] * centre.pop(i) + size[j] * centre.pop(j)) / n
        size[new] = n
        out.append((i, j, cost[i, j], n))
    return out


def dendrogram(edges: DataFrame) -> DataFrame:
    """(step, first, second, height, size) of a language adjacency; a matrix of
    languages is small, so it is merged on the driver."""
    _, square = _square(_collected(edges))
    rows = [(n, a, b, round(h, 6), s) for n, (a, b, h, s) in enumerate(ward(square))]
    return edges.sparkSession.createDataFrame(rows, "step int, first int, second int, height double, size int")


def communities(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(lang, community): greedy modularity, nodes moved while it grows, then
    communities as nodes; each is named by its first language."""
    names, weight = _square(_collected(edges))
    of = list(range(len(names)))
    total = weight.sum()
    now, member = weight, [[i] for i in of]
    while total > 0 and len(now) > 1:
        degree, label = now.sum(1), list(range(len(now)))
        for _ in range(rounds):
            moved = False
            for v in range(len(now)):
                gain = {}
                for c in sorted(set(label)):
                    inside = [u for u in range(len(now)) if label[u] == c and u != v]
                    gain[c] = now[v, inside].sum() - degree[v] * degree[inside].sum() / total
                best = max(sorted(gain), key=lambda c: round(gain[c], 12))
                if gain[best] > gain[label[v]] + 1e-12:
                    label[v], moved = best, True
            if not moved:
                break
        kept = sorted(set(label))
        if len(kept) == len(now):
            break
        hit = np.array([[float(label[v] == c) for v in range(len(now))] for c in kept])
        member = [[i for v in range(len(now)) if label[v] == c for i in member[v]] for c in kept]
        now = hit @ now @ hit.T
    rows = [(names[i], names[min(m)]) for m in member for i in m]
    return edges.sparkSession.createDataFrame(rows, "lang string, community string")
