"""A network that judges analogies of words, trained with Spark.

A word is embedded by convolutions of several widths over its letters' vectors,
of which the largest value of each filter stays.  A classifier looks at four
embedded words: at a and b, and with the same filters at c and d, in each
dimension, then at both together.  Embedding and classifier are models of their
own, so that one language's classifier can be put behind another's embedding.

Training is data-parallel: in each step every task sums up the gradients of its
rows of the step's batch, groups of tasks are summed up by Spark, and the driver,
which holds nothing but the models, takes a step of Adam.  All languages are
trained in the same steps.  Gradients travel as whole numbers, so their sum does
not depend on the order in which tasks end.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrad.operators.analogies import EQUIVALENT

Arrays = dict[str, np.ndarray]
#: Widths of the filters over letters, filters of each, and dimensions of a letter.
WIDTHS, FILTERS, LETTER = (2, 3, 4, 5, 6), 16, 16
#: Filters over two words, and over two pairs.
PAIR, BOTH = 16, 8
#: A gradient's unit as a whole number.
UNIT = 1 << 30


@dataclass(frozen=True)
class Embedding:
    """Letters, and the vectors and filters that make a word's vector of them."""

    letters: tuple[str, ...]
    arrays: Arrays

    @staticmethod
    def fresh(letters: list[str], rng: np.random.Generator) -> Embedding:
        """Besides the letters there are numbers for a word's begin, its end, and any other character."""
        out = {"letters": rng.normal(0, 0.3, (len(letters) + 3, LETTER))}
        for w in WIDTHS:
            out[f"filters{w}"] = rng.normal(0, 1 / math.sqrt(w * LETTER * 0.3), (w * LETTER, FILTERS))
            out[f"bias{w}"] = np.zeros(FILTERS)
        return Embedding(tuple(letters), out)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the letters with begin and end, filled up with -1, and the lengths."""
        n = len(self.letters)
        number = {c: i for i, c in enumerate(self.letters)}
        lengths = np.array([len(w) + 2 for w in words])
        out = np.full((len(words), max(int(lengths.max(initial=0)), max(WIDTHS))), -1)
        for i, w in enumerate(words):
            out[i, : len(w) + 2] = [n, *[number.get(c, n + 2) for c in w], n + 1]
        return out, lengths

    def forward(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """The words' vectors, and what the gradients need."""
        ids, lengths = self.encode(words)
        vectors = np.where(ids[:, :, None] >= 0, self.arrays["letters"][ids], 0.0)
        out, seen = [], []
        for w in WIDTHS:
            windows = np.lib.stride_tricks.sliding_window_view(vectors, w, axis=1).transpose(0, 1, 3, 2).reshape(len(words), -1, w * LETTER)
            value = windows @ self.arrays[f"filters{w}"] + self.arrays[f"bias{w}"]
            # a window stands inside its word; a word shorter than the filter has one
            value[np.arange(windows.shape[1])[None, :] > np.maximum(lengths - w, 0)[:, None]] = -np.inf
            at = value.argmax(axis=1)
            out.append(np.take_along_axis(value, at[:, None, :], axis=1)[:, 0])
            seen.append((windows, at))
        return np.concatenate(out, axis=1), (ids, seen)

    def backward(self, wanted: np.ndarray, memory: tuple) -> Arrays:
        """Gradients of the arrays, from those of the words' vectors."""
        ids, seen = memory
        n = len(ids)
        out = {k: np.zeros_like(v) for k, v in self.arrays.items()}
        back = np.zeros((n, ids.shape[1], LETTER))
        for k, (w, (windows, at)) in enumerate(zip(WIDTHS, seen, strict=True)):
            part = wanted[:, k * FILTERS : (k + 1) * FILTERS]
            out[f"bias{w}"] = part.sum(axis=0)
            chosen = np.take_along_axis(windows[:, :, :, None], at[:, None, None, :], axis=1)[:, 0]
            out[f"filters{w}"] = np.einsum("nwf,nf->wf", chosen, part)
            spread = (part[:, None, :] * self.arrays[f"filters{w}"][None]).reshape(n, w, LETTER, FILTERS)
            for j in range(w):
                np.add.at(back, (np.arange(n)[:, None], at + j), spread[:, j].transpose(0, 2, 1))
        there = ids >= 0
        np.add.at(out["letters"], ids[there], back[there])
        return out


@dataclass(frozen=True)
class Classifier:
    """Filters over the vectors of four words."""

    arrays: Arrays

    @staticmethod
    def fresh(rng: np.random.Generator) -> Classifier:
        dim = len(WIDTHS) * FILTERS
        shapes = {"pair": (2, PAIR), "both": (2 * PAIR, BOTH), "out": (dim, BOTH)}
        scales = {"pair": 0.7, "both": 0.25, "out": 1 / math.sqrt(dim * BOTH)}
        out = {k: rng.normal(0, scales[k], s) for k, s in shapes.items()}
        return Classifier(out | {"pair_bias": np.zeros(PAIR), "both_bias": np.zeros(BOTH), "out_bias": np.zeros(1)})

    def forward(self, quads: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Probabilities of quads (rows x 4 x dimensions), and what the gradients need."""
        w = self.arrays
        pairs = quads.reshape(len(quads), 2, 2, -1).transpose(0, 1, 3, 2)  # row, pair, dimension, word
        first = np.maximum(pairs @ w["pair"] + w["pair_bias"], 0)
        joined = first.transpose(0, 2, 1, 3).reshape(len(quads), pairs.shape[2], -1)
        second = np.maximum(joined @ w["both"] + w["both_bias"], 0)
        score = np.einsum("ndb,db->n", second, w["out"]) + w["out_bias"]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30))), (pairs, first, joined, second)

    def backward(self, wanted: np.ndarray, memory: tuple) -> tuple[Arrays, np.ndarray]:
        """Gradients of the arrays and of the quads, from those of the scores."""
        w, (pairs, first, joined, second) = self.arrays, memory
        out = {"out": np.einsum("n,ndb->db", wanted, second), "out_bias": np.array([wanted.sum()])}
        back = wanted[:, None, None] * w["out"][None] * (second > 0)
        out["both"], out["both_bias"] = np.einsum("ndp,ndb->pb", joined, back), back.sum(axis=(0, 1))
        back = (back @ w["both"].T).reshape(*joined.shape[:2], 2, PAIR).transpose(0, 2, 1, 3) * (first > 0)
        out["pair"], out["pair_bias"] = np.einsum("ncdw,ncdp->wp", pairs, back), back.sum(axis=(0, 1, 2))
        return out, (back @ w["pair"].T).transpose(0, 1, 3, 2).reshape(len(pairs), 4, -1)


@dataclass(frozen=True)
class Network:
    """A language's embedding and classifier."""

    embedding: Embedding
    classifier: Classifier

    @staticmethod
    def fresh(letters: list[str], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        return Network(Embedding.fresh(letters, rng), Classifier.fresh(rng))

    @property
    def arrays(self) -> Arrays:
        return {f"embedding.{k}": v for k, v in self.embedding.arrays.items()} | {f"classifier.{k}": v for k, v in self.classifier.arrays.items()}

    def flat(self) -> np.ndarray:
        """All numbers of all arrays in the order of their names."""
        return np.concatenate([v.ravel() for _, v in sorted(self.arrays.items())])

    def shaped(self, flat: np.ndarray) -> Arrays:
        """Such numbers as arrays again."""
        out, at = {}, 0
        for k, v in sorted(self.arrays.items()):
            out[k], at = flat[at : at + v.size].reshape(v.shape), at + v.size
        return out

    def with_flat(self, flat: np.ndarray) -> Network:
        arrays = self.shaped(flat)
        part = lambda name: {k.split(".")[1]: v for k, v in arrays.items() if k.startswith(name)}
        return Network(Embedding(self.embedding.letters, part("embedding.")), Classifier(part("classifier.")))

    def gradient(self, quads: list[tuple[str, str, str, str]], truth: np.ndarray) -> tuple[np.ndarray, float]:
        """The gradient of the cross entropy summed over quads, and that sum."""
        words = sorted({w for q in quads for w in q})
        at = {w: i for i, w in enumerate(words)}
        places = np.array([[at[w] for w in q] for q in quads])
        vectors, memory = self.embedding.forward(words)
        p, more = self.classifier.forward(vectors[places])
        arrays, back = self.classifier.backward(p - truth, more)
        wanted = np.zeros_like(vectors)
        np.add.at(wanted, places, back)
        every = {f"embedding.{k}": v for k, v in self.embedding.backward(wanted, memory).items()} | {f"classifier.{k}": v for k, v in arrays.items()}
        loss = -np.log(np.maximum(np.where(truth > 0.5, p, 1 - p), 1e-12)).sum()
        return np.concatenate([v.ravel() for _, v in sorted(every.items())]), float(loss)


def judged(embedding: Embedding, classifiers: list[Classifier], quads: list[tuple[str, str, str, str]]) -> list[np.ndarray]:
    """Probabilities of the quads by each classifier, behind one embedding."""
    words = sorted({w for q in quads for w in q})
    at = {w: i for i, w in enumerate(words)}
    vectors = embedding.forward(words)[0][np.array([[at[w] for w in q] for q in quads])]
    return [c.forward(vectors)[0] for c in classifiers]


@dataclass
class Adam:
    """Steps of Adam for one network's numbers."""

    rate: float
    mean: np.ndarray
    square: np.ndarray
    steps: int = 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient**2
        return self.rate * (self.mean / (1 - 0.9**self.steps)) / (np.sqrt(self.square / (1 - 0.999**self.steps)) + 1e-8)


@dataclass
class Trained:
    """Networks by language, and the mean loss of each step."""

    networks: dict[str, Network]
    losses: dict[str, list[float]] = field(default_factory=dict)

    def save(self, spark: SparkSession, folder: str) -> None:
        """As a table of arrays, beside the letters and the losses."""
        rows = []
        for lang, network in self.networks.items():
            rows.append((lang, "letters", list(network.embedding.letters), [], []))
            rows.append((lang, "losses", [], [len(self.losses.get(lang, []))], self.losses.get(lang, [])))
            rows += [(lang, k, [], list(v.shape), v.ravel().tolist()) for k, v in network.arrays.items()]
        spark.createDataFrame(rows, "lang string, name string, letters array<string>, shape array<int>, values array<double>").write.mode("overwrite").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Trained:
        out = Trained({})
        found: dict[str, dict] = {}
        for r in spark.read.parquet(folder).collect():  # a few arrays a language
            found.setdefault(r["lang"], {})[r["name"]] = list(r["letters"]) if r["name"] == "letters" else np.array(r["values"]).reshape(r["shape"])
        for lang, parts in sorted(found.items()):
            letters, losses = parts.pop("letters"), parts.pop("losses")
            empty = Network.fresh(letters)
            out.networks[lang] = empty.with_flat(np.concatenate([v.ravel() for _, v in sorted(parts.items())]))
            out.losses[lang] = losses.tolist()
        return out


#: Quads whose gradients, or probabilities, a task finds at once.
ROWS = 256
QUAD = ("a", "b", "c", "d")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[str, str, str, str]], np.ndarray]]:
    """(language, quads, truth) of at most so many rows of one language; null words are empty."""
    for batch in batches:
        of: dict[str, list[int]] = {}
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            of.setdefault(lang, []).append(i)
        words = [[w or "" for w in batch.column(x).to_pylist()] for x in QUAD]
        truth = np.array([bool(x) for x in batch.column("valid").to_pylist()], float)
        for lang, rows in of.items():
            for k in range(0, len(rows), ROWS):
                part = rows[k : k + ROWS]
                yield lang, [tuple(w[i] for w in words) for i in part], truth[part]


def _turned(quad: tuple[str, str, str, str], step: int) -> tuple[str, str, str, str]:
    """One of the equivalent forms, another one in other steps."""
    form = EQUIVALENT[zlib.crc32("|".join((*quad, str(step))).encode()) % len(EQUIVALENT)]
    return tuple(quad["abcd".index(x)] for x in form)


def _added(rows: pa.Table) -> pa.Table:
    """Gradients of a group of tasks as one."""
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("gradient"))
    sums = [sum(rows.column(c).to_pylist()) for c in ("n", "loss")]
    return pa.table({"lang": rows.column("lang").slice(0, 1), "n": pa.array(sums[:1], pa.int64()), "loss": pa.array(sums[1:], pa.int64()), "gradient": pa.array([total.tobytes()], pa.binary())})


def train(quads: DataFrame, steps: int = 60, batch: int = 256, rate: float = 0.01, seed: int = 0) -> Trained:
    """A network for each language of quads (lang, a, b, c, d, valid).

    A language's quads are dealt into batches of about that many rows by their
    hash; each step takes the next batch of every language, each quad in one of its
    equivalent forms.  With one name for all languages, one network learns them
    all.  Languages without quads have no network.
    """
    spark = quads.sparkSession
    rows = quads.select("lang", *[F.coalesce(x, F.lit("")).alias(x) for x in QUAD], "valid")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    letters: dict[str, list[str]] = {lang: [] for lang in sizes}
    for lang, ch in rows.select("lang", F.explode(F.array_distinct(F.split(F.concat(*QUAD), ""))).alias("ch")).where("ch <> ''").distinct().orderBy("lang", "ch").collect():  # alphabets
        letters[lang].append(ch)
    number = spark.createDataFrame([(lang, max(1, round(n / batch))) for lang, n in sizes.items()], "_lang string, batches long")
    of = F.pmod(F.xxhash64(*QUAD, "valid", F.lit(seed)), F.col("batches"))
    dealt = rows.join(F.broadcast(number), F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", *QUAD, "valid", of.alias("batch"))
    # sorted, so that a step reads its batch alone
    dealt = dealt.sortWithinPartitions("lang", "batch").persist()
    groups = max(1, math.isqrt(dealt.rdd.getNumPartitions()))
    networks = {lang: Network.fresh(letters[lang], seed) for lang in sorted(sizes, key=str)}
    adams = {lang: Adam(rate, np.zeros_like(n.flat()), np.zeros_like(n.flat())) for lang, n in networks.items()}
    out = Trained(networks, {lang: [] for lang in networks})
    for step in range(steps):
        wanted = [F.col("lang").eqNullSafe(F.lit(lang)) & (F.col("batch") == step % max(1, round(n / batch))) for lang, n in sizes.items()]
        if not wanted:
            break
        now = dict(out.networks)

        def run(batches: Iterator[pa.RecordBatch], now: dict[str, Network] = now, step: int = step) -> Iterator[pa.RecordBatch]:
            sums: dict[str, list] = {}
            for lang, those, truth in _chunks(batches):
                gradient, loss = now[lang].gradient([_turned(q, step) for q in those], truth)
                held = sums.setdefault(lang, [0, 0, 0])
                held[0] += len(those)
                held[1] += round(loss * UNIT)
                held[2] = held[2] + np.rint(gradient * UNIT).astype(np.int64)
            if sums:
                n, loss, gradients = zip(*sums.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(n, pa.int64()), pa.array(loss, pa.int64()), pa.array([g.tobytes() for g in gradients], pa.binary())], ["lang", "n", "loss", "gradient"])

        taken = dealt.where(functools.reduce(lambda x, y: x | y, wanted)).drop("batch")
        found = taken.mapInArrow(run, "lang string, n long, loss long, gradient binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(groups)))
        sums = found.groupBy("lang", "part").applyInArrow(_added, "lang string, n long, loss long, gradient binary")
        total: dict[str, list] = {}
        for r in sums.collect():  # a gradient for each language and group of tasks
            held = total.setdefault(r["lang"], [0, 0, 0])
            held[0], held[1], held[2] = held[0] + r["n"], held[1] + r["loss"], held[2] + np.frombuffer(bytes(r["gradient"]), np.int64)
        for lang, (n, loss, gradient) in total.items():
            network = out.networks[lang]
            out.networks[lang] = network.with_flat(network.flat() - adams[lang].step(gradient / UNIT / n))
            out.losses[lang].append(loss / UNIT / n)
    dealt.unpersist()
    return out


def matrix(trained: Trained, quads: DataFrame, mode: str = "full") -> DataFrame:
    """(model_lang, data_lang, acc_valid, acc_invalid, acc_raw): every language's
    network on every language's quads (lang, a, b, c, d, valid).  In mode 'full' a
    network judges with its own embedding, in mode 'partial' its classifier stands
    behind the embedding of the data's language; quads of a language without one
    are then left out.  Quads go through once; tasks give counts alone.
    """
    if mode not in ("full", "partial"):
        raise ValueError("mode is full or partial")
    networks = dict(trained.networks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], np.ndarray] = {}
        for lang, those, truth in _chunks(batches):
            if mode == "full":
                found = {m: judged(n.embedding, [n.classifier], those)[0] for m, n in networks.items()}
            elif lang in networks:
                found = dict(zip(networks, judged(networks[lang].embedding, [n.classifier for n in networks.values()], those), strict=True))
            else:
                continue
            for m, p in found.items():
                right, good = (p > 0.5) == (truth > 0.5), truth > 0.5
                add = np.array([good.sum(), (right & good).sum(), (~good).sum(), (right & ~good).sum()])
                counts[m, lang] = counts.get((m, lang), 0) + add
        if counts:
            columns = [pa.array([k[i] for k in counts], pa.string()) for i in (0, 1)] + [pa.array([int(v[i]) for v in counts.values()], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["model_lang", "data_lang", "valid", "right_valid", "invalid", "right_invalid"])

    named = quads.select(F.col("lang").cast("string").alias("lang"), *QUAD, "valid")
    found = named.mapInArrow(run, "model_lang string, data_lang string, valid long, right_valid long, invalid long, right_invalid long")
    sums = found.groupBy("model_lang", "data_lang").agg(*[F.sum(c).alias(c) for c in ("valid", "right_valid", "invalid", "right_invalid")])
    share = lambda right, n: F.round(F.try_divide(F.expr(right), F.expr(n)), 6)
    return sums.select("model_lang", "data_lang", share("right_valid", "valid").alias("acc_valid"), share("right_invalid", "invalid").alias("acc_invalid"), share("right_valid + right_invalid", "valid + invalid").alias("acc_raw"))
