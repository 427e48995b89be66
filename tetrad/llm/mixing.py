"""Mixing to target weights with soft membership.

A classifier learned from a labelled table gives every document posteriors over
the domains: word counts in hashed buckets, smoothed, and a softmax of the mean
log likelihood.  How far these are told apart is fitted too, so that posteriors
are probabilities: the value under which the labels of the other half are
likeliest.  The labelled rows are halved by a hash of the id, and a document is
judged by the half that its id is not in, so never by a model that has learned
from its own label.  At most about ``SAMPLE`` rows are learned from, as many of
each domain; which, a hash of id and text says.

Rates r >= 0 for documents are then fitted by projected-gradient least squares,
with momentum, so that the expected tokens of each domain, sum over documents of
r * tokens * posterior, match the targets.

A rate is a function of the document's own row and of the residuals of the
steps so far (as many numbers as domains), so the driver holds nothing else,
and every step is one pass over a narrow written table with one row of sums
per partition.

Targets are weights; their total is fitted with the rates.  It is at least the
one for which no domain needs to shrink, so that a mix repeats documents of
scarce domains; with a floor of 1 it drops none, whatever the posteriors.
``off`` says how far the fit is from the target that it misses by the largest
share.  Where that is more than ``LOOSE``, the posteriors cannot meet the
targets, as when texts do not tell the domains apart: then nothing is mixed,
every rate is 1, and ``off`` is that of the documents as they are.
``copies`` turns a rate into a whole number of copies: its whole part, and one
more for the share of ids (by hash) that its fraction says.

Defined results: null and empty texts have no tokens, the prior as posterior
and rate 1; rows with null or unknown labels are not learned from; repeated
rows have the same rate; a domain without tokens or without labelled rows is
left out of the fit, and if fewer than two are left, every rate is 1; extra
columns are kept by ``mixed``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tetrad.llm import kernels as K
from tetrad.llm.shared import blocks, release, small_batches, text_bytes, texts, unused, written

#: Labelled rows that the classifier learns from, about.
SAMPLE = 20_000
BUCKETS = 1 << 15
#: How far apart mean log likelihoods may be told: the values that are tried.
SHARPNESS = np.geomspace(0.5, 500, 61)
#: Steps of the least squares at most; they end when every target is met to CLOSE of it, or when nothing moves any more.
ROUNDS, CLOSE = 200, 1e-4
#: A fit that misses a target by a larger share than this is none.
LOOSE = 0.1


class Model(NamedTuple):
    """For each half of the ids, learned from the other one: log likelihoods
    (half, bucket, domain), log priors, and how far they are told apart; and which
    domains have labelled rows."""

    likely: np.ndarray
    prior: np.ndarray
    sharpness: np.ndarray
    labelled: np.ndarray


class Fit(NamedTuple):
    """Steps, each a direction in the space of domains and a momentum; targets and
    tokens reached by domain; and by which share of it a target is missed at most."""

    steps: list[tuple[np.ndarray, float]]
    targets: np.ndarray
    reached: np.ndarray
    off: float


def _half(key: str) -> Column:
    """Which half of the ids a row is in."""
    return F.pmod(F.xxhash64(F.lit("half"), f"`{key}`"), F.lit(2)).cast("int")


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of texts: first row, count, owner of each word, bucket of each word."""
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets):
        part, at = K.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends = K.spans(~K.WHITE[part], at)
        yield a, b - a, K.owners(starts, at), (K.hashes(part, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)


def learn(labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """The classifier of both halves."""
    small_batches(labelled.sparkSession)
    size = len(domains)
    known = labelled.where(F.col(f"`{label}`").isin(domains)).select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{label}`").alias("label"), _half(key).alias("half"), F.xxhash64(F.lit("sample"), f"`{key}`", f"`{text}`").alias("hash"))
    there = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # one row a domain
    part = F.coalesce(*[F.when(F.col("label") == d, F.lit(int(min(1.0, sample / size / n) * 1_000_000))) for d, n in there.items()], F.lit(0))
    known = written(known.where(F.pmod("hash", F.lit(1_000_000)) < part).select("text", "label", "half"), "labelled")
    number = {d: i for i, d in enumerate(domains)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((2, size, BUCKETS), np.int64), np.zeros((2, size), np.int64)
        for batch in batches:
            of = batch.column("half").to_numpy() * size + np.array([number[x] for x in batch.column("label").to_pylist()], np.int64)
            rows += np.bincount(of, minlength=2 * size).reshape(2, size)
            for first, _, owner, bucket in _words(batch.column("text")):
                counts += np.bincount(of[first + owner] * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*at, *(-1 - np.arange(2 * size))], pa.int64()), pa.array([*counts.reshape(-1)[at], *rows.reshape(-1)], pa.int64())], ["at", "n"])

    counts, rows = np.zeros(2 * size * BUCKETS), np.zeros(2 * size)
    for r in known.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 2 x domains x BUCKETS rows
        if r["at"] < 0:
            rows[-1 - r["at"]] = r["n"]
        else:
            counts[r["at"]] = r["n"]
    # a half's model is of the other half
    counts, rows = counts.reshape(2, size, BUCKETS)[::-1], rows.reshape(2, size)[::-1]
    common = (counts.sum(1, keepdims=True) + 0.1) / (counts.sum((1, 2), keepdims=True) + 0.1 * BUCKETS)
    likely = np.log((counts + 200 * common) / (counts.sum(2, keepdims=True) + 200))
    plain = Model(np.ascontiguousarray(likely.transpose(0, 2, 1)), np.log((rows + 1) / (rows.sum(1, keepdims=True) + size)), np.ones(2), rows.sum(0) > 0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Minus log likelihood of the labels of each half, at each sharpness."""
        total = np.zeros((2, len(SHARPNESS)))
        for batch in batches:
            half = batch.column("half").to_numpy()
            own = np.array([number[x] for x in batch.column("label").to_pylist()], np.int64)
            _, found = _told(batch.column("text"), half, plain)
            for k, sharp in enumerate(SHARPNESS):
                logit = plain.prior[half] + found * sharp
                top = logit.max(1, keepdims=True, initial=-np.inf)
                off = (top + np.log(np.exp(logit - top).sum(1, keepdims=True)))[:, 0] - logit[np.arange(len(own)), own]
                total[:, k] += np.bincount(half, weights=off, minlength=2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["k", "v"])

    off = np.zeros(2 * len(SHARPNESS))
    for r in known.mapInArrow(judge, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # two rows a value
        off[r["k"]] = r["v"]
    return plain._replace(sharpness=SHARPNESS[off.reshape(2, -1).argmin(1)])


def _told(column: pa.Array, half: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the mean log likelihood of its words in each domain."""
    size = model.prior.shape[1]
    sizes, found = np.zeros(len(column), np.int64), np.zeros((len(column), size))
    flat = model.likely.reshape(-1, size)
    for first, n, owner, bucket in _words(column):
        count = sizes[first : first + n] = np.bincount(owner, minlength=n)
        at = half[first + owner].astype(np.int64) * BUCKETS + bucket
        for k in range(size):
            found[first : first + n, k] = np.bincount(owner, weights=flat[at, k], minlength=n) / np.maximum(count, 1)
    return sizes, found


def _membership(column: pa.Array, half: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its posteriors (text, domain)."""
    sizes, found = _told(column, half, model)
    logit = model.prior[half] + found * model.sharpness[half][:, None]
    p = np.exp(logit - logit.max(1, keepdims=True, initial=-np.inf))
    return sizes, p / p.sum(1, keepdims=True)


def posteriors(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, p): words of each text and the posterior of each domain."""
    small_batches(docs.sparkSession)
    size = model.prior.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, p = _membership(batch.column(1), batch.column(2).to_numpy(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), size).cast(pa.list_(pa.float64()))], [key, "n_tokens", "p"])
        release()

    source = texts(docs, key, text=text).select(f"`{key}`", "text", _half(key))
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, n_tokens long, p array<double>")


def rates(p: np.ndarray, steps: list[tuple[np.ndarray, float]], floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the gradient steps, and where the next one starts: each step
    moves along the posteriors and stops at the floor, and momentum carries on."""
    now = ahead = np.ones(len(p))
    for step, momentum in steps:
        last, now = now, np.maximum(ahead - p @ step, floor)
        ahead = now + momentum * (now - last)
    return now, ahead


def fit(member: DataFrame, weights: np.ndarray, floor: float = 0.0, rounds: int = ROUNDS, close: float = CLOSE) -> Fit:
    """Least squares of (expected tokens - targets), each domain in units of its
    own Gram diagonal; the step is one over the scaled Gram matrix's largest
    eigenvalue.  Momentum is that of accelerated gradients, begun anew when the
    misfit grows.
    """
    size = len(weights)

    def summed(steps: list[tuple[np.ndarray, float]]) -> np.ndarray:
        """Expected tokens a domain at the rates of the steps and at the next one's start, and the Gram matrix."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * size + size * size)
            for batch in batches:
                if not batch.num_rows:
                    continue
                n = batch.column("n_tokens").to_numpy()
                p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                for k, r in enumerate(rates(p, steps, floor)):
                    total[k * size : (k + 1) * size] += (r * n) @ p
                total[2 * size :] += ((p * n[:, None]).T @ p).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

        rows = member.select("n_tokens", "p").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(2 * size + size * size)
        for r in rows:
            out[r["k"]] = r["v"]
        return out

    first = summed([])
    reached, gram = first[:size], first[2 * size :].reshape(size, size)
    there = (reached > 0) & (weights > 0)
    if there.sum() < 2:
        return Fit([], np.where(there, reached, 0), reached, 0.0)
    share = np.where(there, weights, 0) / weights[there].sum()
    least = (reached[there] / share[there]).max()
    scale = np.where(there, 1 / np.sqrt(np.maximum(np.diag(gram), 1e-12)), 0)
    top = np.linalg.eigvalsh(scale[:, None] * gram * scale).max()
    along = scale * share
    wanted = lambda x: share * max(least, (along @ (scale * x)) / (along @ along))
    missed = lambda x: (np.abs(x - wanted(x))[there] / wanted(x)[there]).max()
    unmixed = Fit([], wanted(reached), reached, float(missed(reached)))
    steps: list[tuple[np.ndarray, float]] = []
    ahead, pace, misfit = reached, 1.0, np.inf
    for _ in range(rounds):
        if missed(reached) <= close:
            break
        after = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        steps.append((scale * (scale * (ahead - wanted(ahead))) / top, (pace - 1) / after))
        both = summed(steps)
        last, reached, ahead, pace = reached, both[:size], both[size : 2 * size], after
        now = float(((scale * (reached - wanted(reached))) ** 2).sum())
        if now > misfit:  # too fast: the next step starts from here
            steps[-1] = (steps[-1][0], 0.0)
            ahead, pace = reached, 1.0
        elif np.abs(scale * (reached - last)).max() <= 1e-9 * np.abs(scale * reached).max():
            break  # at the closest point
        misfit = now
    found = Fit(steps, wanted(reached), reached, float(missed(reached)))
    return found if found.off <= LOOSE else unmixed


def _fitted(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], key: str, text: str, label: str, floor: float) -> tuple[Model, DataFrame, Fit]:
    """The classifier, the documents' posteriors, and the fit."""
    domains = sorted(targets)
    model = learn(labelled, domains, key, text, label)
    member = written(posteriors(docs, model, key, text), "posteriors")
    weights = np.array([float(targets[d]) for d in domains]) * model.labelled
    return model, member, fit(member, weights, floor)


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], key: str = "doc_id", text: str = "text", label: str = "lang", floor: float = 0.0) -> DataFrame:
    """(key, n_tokens, domain, p, rate, off, copies) of every document; no rate is below the floor."""
    domains = sorted(targets)
    _, member, (steps, _, _, off) = _fitted(docs, labelled, targets, key, text, label, floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(domains))
            best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
            r = np.where(batch.column("n_tokens").to_numpy() > 0, rates(p, steps, floor)[0], 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_tokens"), pa.array([domains[k] for k in best], pa.string()), pa.array(p.max(1, initial=0) if len(p) else [], pa.float64()), pa.array(r, pa.float64())], [key, "n_tokens", "domain", "p", "rate"])

    kind = member.schema[key].dataType.simpleString()
    rated = member.mapInArrow(run, f"`{key}` {kind}, n_tokens long, domain string, p double, rate double")
    return rated.withColumn("off", F.lit(off)).withColumn("copies", _copies("rate", key))


def _copies(rate: str, key: str) -> Column:
    """Whole copies for a rate; one a hair below a whole number is that number."""
    near = F.col(f"`{rate}`") + 1e-4
    part = F.pmod(F.xxhash64(F.lit("copies"), f"`{key}`"), F.lit(1 << 20)) / (1 << 20)
    return (F.floor(near) + F.when(part < near - F.floor(near), 1).otherwise(0)).cast("long")


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], key: str = "doc_id", text: str = "text", label: str = "lang", floor: float = 0.0) -> DataFrame:
    """The documents with all their columns, each as often as its copies say.

    The posteriors are found again where the documents are read, so that no
    text is shuffled.
    """
    model, _, (steps, *_) = _fitted(docs, labelled, targets, key, text, label, floor)
    rate, copy, half = (unused(docs, c) for c in ("_rate", "_copy", "_half"))
    whole = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    schema = T.StructType([*whole.schema.fields, T.StructField(rate, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, p = _membership(batch.column(text).fill_null(""), batch.column(batch.num_columns - 1).to_numpy(), model)
            found = np.where(sizes > 0, rates(p, steps, floor)[0], 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], rate])
        release()

    copied = whole.withColumn(half, _half(key)).mapInArrow(run, schema).withColumn(copy, F.explode(F.array_repeat(F.lit(1), _copies(rate, key).cast("int"))))
    return copied.drop(rate, copy)
