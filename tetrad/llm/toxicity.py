"""Toxicity through a noisy channel: restore disguised words, then score them.

1. A character language model: counts of three letters in a row over all texts,
   summed over the cluster (one row per triple at most reaches the driver).
2. A token that shows noise (digits or symbols among letters, a letter three
   times in a row, every letter twice, three or more letters standing alone one
   after another) becomes a lattice
   of letters it may stand for; Viterbi finds the likeliest word under the
   language model and the channel's costs.  Tokens without noise have one path
   only and stay as they are, and so do figures without any letter; a token with
   other symbols than those of ``LEET`` and ``BETWEEN`` is decoded if at least
   two and half of its characters are letters.
3. A classifier on the restored words: from at most ``SAMPLE`` labelled rows
   (a bound on the training rows only; every text is scored), each word, word
   start and letter sequence gets the lower confidence bound of its log odds;
   words of one labelled text only are left out, as the label would be learned
   by heart.  A logistic regression gives the score: on the STRONGEST three words
   of a text, and on how many strong words and words with evidence it has in all.

Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have no words and get the score of a text
without any evidence; without labelled rows of both kinds every score is 0;
repeated rows are scored alike, one result each; of different texts of one id
the smallest is learned from; rows of labels that repeat or have null labels are
merged (largest label) or left out; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrad.llm.shared import small_batches, texts, written

#: Most labelled rows that the classifier learns from (chosen by a hash of the id).
SAMPLE = 20_000
#: Words of a text whose strength is a feature of its own; the others count.
STRONGEST = 3
#: Distinct tokens whose scores a process remembers.
MEMORY = 500_000

# Letters that a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}
BETWEEN = ".-_*~'`,:;/\\^\""

_EDGES = re.compile(r"^[^\w@$!|+(<€£¥]+|[^\w@$|+€£¥]+$")
_RUNS = re.compile(r"([^\w])\1+$|^([^\w])\2+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]{1,2}){2,}[^\W_](?!\w)")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_LETTER = re.compile(r"[^\W\d_]")
_LONG = re.compile(r"(.)\1{3,}")
_PAIRS = re.compile(r"(?:([^\W\d_])\1)+")


def _doubled(word: str) -> bool:
    """Every letter stands twice in a row."""
    return len(word) >= 6 and _PAIRS.fullmatch(word) is not None

# ---- the character language model ----------------------------------------

CLASSES = 64


def _classes() -> np.ndarray:
    """Class of each code point below 0x250: 0 ends words, 1-26 are a-z, others share the rest by rule."""
    out = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        ch = chr(c).lower()[:1]
        if "a" <= ch <= "z":
            out[c] = ord(ch) - 96
        elif ch.isalpha():
            out[c] = 27 + ord(ch) * 7 % 37
    return out


CLASS = _classes()


def letter_class(c: str) -> int:
    n = ord(c)
    return int(CLASS[n]) if n < 0x250 else (27 + n * 7 % 37 if c.isalpha() else 0)


def triples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(triple, n): how often three letter classes follow each other, over all texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                whole = "\0\0" + "\0\0".join(batch.column(0).slice(at, 100).to_pylist()) + "\0\0"
                points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
                c = np.where(points < 0x250, CLASS[np.minimum(points, 0x24F)], np.where(points >= 0x370, 27 + points * 7 % 37, 0)).astype(np.int32)
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["triple", "n"])

    return texts(docs, text=text).mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))


def _spelled(word: tuple) -> str:
    out = []
    while word:
        word, c = word
        out.append(c)
    return "".join(reversed(out))


@dataclass
class Channel:
    """The language model and the decoder."""

    cost: np.ndarray  # minus log probability of the third class after two
    known: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, counted: list[tuple[int, int]]) -> Channel:
        n = np.zeros((CLASSES, CLASSES, CLASSES))
        for triple, count in counted:
            n.reshape(-1)[triple] = count
        pair, single = n.sum(0), n.sum((0, 1))
        base = (single + 0.5) / (single.sum() + 0.5 * CLASSES)
        two = (pair + 8 * base) / (pair.sum(1, keepdims=True) + 8)
        return cls(-np.log((n + 4 * two) / (n.sum(2, keepdims=True) + 4)).astype(np.float32))

    def decode(self, token: str) -> str:
        """The likeliest word that the token stands for."""
        steps: list[list[tuple[str, float]]] = []
        run = 0
        for k, c in enumerate(token):
            run = run + 1 if k and token[k - 1] == c else 1
            options: list[tuple[str, float]] = []
            if _LETTER.match(c):
                options.append((c, 0.0 if run < 3 else 6.0))
                if run > 1:  # a repeated letter may be one letter drawn out
                    options.append(("", 2.0 if run == 2 else 0.2))
            else:
                options += [(x, 1.5) for x in LEET.get(c, "")]
                if c in BETWEEN:
                    options.append(("", 0.7))
                options = options or [("", 3.0)]
            steps.append(options)
        # state: last two classes -> (cost, word so far as (all before, last letter)), so that time is linear
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in steps:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, word) in states.items():
                for c, price in options:
                    if c:
                        k = letter_class(c)
                        to, total, longer = (b, k), cost + price + float(self.cost[a, b, k]), (word, c)
                    else:
                        to, total, longer = (a, b), cost + price + 1.0, word
                    if to not in after or total < after[to][0]:
                        after[to] = (total, longer)
            states = after
        ended = [(cost + float(self.cost[a, b, 0]), word) for (a, b), (cost, word) in states.items()]
        least = min(cost for cost, _ in ended)
        return min(_spelled(word) for cost, word in ended if cost == least)

    def restore(self, token: str) -> str:
        """The token in lower case without edge marks, and decoded if it shows noise."""
        word = _RUNS.sub("", token.lower())
        word = _EDGES.sub("", word)
        letters = len(_LETTER.findall(word))
        if letters == len(word) and not _doubled(word) and not _THRICE.search(word):
            return word
        # a drawn out letter or mark tells no more than a short run of it
        word = _LONG.sub(r"\1\1\1", word)
        # letters, or symbols for them, must make the word: figures alone are none
        if not letters or not all(_LETTER.match(c) or c in LEET or c in BETWEEN for c in word):
            return word if letters < 2 or letters * 2 < len(word) else self.decode(word)
        return self.decode(word)

    def words(self, text: str) -> list[str]:
        """Tokens of a text; letters that stand alone in a row are one token."""
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]+", "", m[0]), text)
        return text.split()


def features(word: str) -> list[str]:
    """The word, its starts, and its letter sequences."""
    if len(word) < 3:
        return ["=" + word]
    out = ["=" + word, *("^" + word[:n] for n in range(3, min(7, len(word)))), *("$" + word[-n:] for n in (4, 5) if n < len(word))]
    for n in (4, 5, 6):
        out += [word[i : i + n] for i in range(1, len(word) - n)]
    return out


def bound(hits: np.ndarray, misses: np.ndarray, total_hits: float, total_misses: float, z: float = 1.64) -> np.ndarray:
    """Lower confidence bound of the log odds ratio of a feature, at least 0."""
    a, b = hits + 0.5, misses + 0.5
    odds = np.log(a / (total_hits + 1)) - np.log(b / (total_misses + 1))
    return np.maximum(odds - z * np.sqrt(1 / a + 1 / b), 0)


@dataclass
class Model:
    """Weights of features, and of a text's strongest words."""

    channel: Channel
    odds: dict[str, float]
    weights: np.ndarray | None

    def word(self, token: str) -> float:
        odds = self.odds
        return max((odds.get(f, 0.0) for f in features(self.channel.restore(token))), default=0.0)

    def evidence(self, text: str, known: dict[str, float]) -> list[float]:
        found = []
        for token in self.channel.words(text):
            v = known.get(token)
            if v is None:
                v = known[token] = self.word(token)
            if v:
                found.append(v)
        found.sort(reverse=True)
        top = [*found, *[0.0] * STRONGEST][:STRONGEST]
        strong = sum(v > 2.5 for v in found)
        return [*top, math.log1p(strong), math.log1p(len(found))]

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights[1:] + self.weights[0], -30, 30)))


def logistic(rows: np.ndarray, goal: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Newton's method; the first weight is the constant."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - goal) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(key: str) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    channel = Channel.of([(r["triple"], r["n"]) for r in triples(docs, text).collect()])  # at most CLASSES ** 3 rows
    given = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    n = given.count()
    if n > sample:
        # a hash threshold, so that which rows are taken depends on their id only
        given = given.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    # about ``sample`` ids at most, so they may be broadcast; one text an id
    rows = texts(docs, key, text=text).join(F.broadcast(given), key).groupBy(key).agg(F.min("text").alias("text"), F.max("_y").alias("_y"))
    rows = written(rows.select("text", "_y"), "labelled")

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: dict[str, list[int]] = {}
            known: dict[str, str] = {}
            y = batch.column("_y").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                seen = set()
                for token in channel.words(text):
                    word = known.get(token)
                    if word is None:
                        word = known[token] = channel.restore(token)
                    seen.add(word)
                for word in seen:
                    hits.setdefault(word, [0, 0])[y[i] > 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.string()), *[pa.array([v[k] for v in hits.values()], pa.int64()) for k in (0, 1)]], ["word", "misses", "hits"])

    totals = {r["_y"]: r["count"] for r in rows.groupBy((F.col("_y") > 0).cast("int").alias("_y")).count().collect()}
    if len(totals) < 2:
        return Model(channel, {}, None)
    counted = rows.mapInArrow(restored, "word string, misses long, hits long").groupBy("word").agg(F.sum("misses").alias("misses"), F.sum("hits").alias("hits"))
    index: dict[str, int] = {}
    where, hit, miss = [], [], []
    # words of the bounded sample only; a word seen once tells nothing
    for r in counted.where("hits + misses > 1").toLocalIterator():
        for f in set(features(r["word"])):
            where.append(index.setdefault(f, len(index)))
            hit.append(r["hits"])
            miss.append(r["misses"])
    hits, misses = (np.minimum(np.bincount(np.array(where, np.int64), weights=v, minlength=len(index)), totals[k]) for k, v in ((1, hit), (0, miss)))
    odds = bound(hits, misses, totals[1], totals[0])
    model = Model(channel, {f: float(odds[i]) for f, i in index.items() if odds[i] > 0.5}, None)
    found = _evidence(rows, model, "_y").collect()  # at most the sample's rows
    x = np.array([r["_e"] for r in found])
    model.weights = logistic(x, np.array([float(r["_y"] > 0) for r in found]))
    return model


def _evidence(rows: DataFrame, model: Model, *keys: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if len(known) > MEMORY:
                    known.clear()
                out.append(model.evidence(text, known))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(out, pa.list_(pa.float64())), pa.array(model.score(np.array(out).reshape(len(out), STRONGEST + 2)), pa.float64())], [*keys, "_e", "score"])

    kinds = {k: rows.schema[k].dataType.simpleString() for k in keys}
    return rows.select(*[f"`{k}`" for k in keys], "text").mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", _e array<double>, score double")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """(key, held_out, score, predicted) of every text."""
    scored = _evidence(texts(docs, key, text=text), model, key)
    return scored.select(f"`{key}`", held_out(key).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
