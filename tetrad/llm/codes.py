"""Vector codes: each part of a vector as the number of its codebook's nearest entry.

Components become whole numbers, and vectors are cut into equal parts.  A part's
codebook begins as that part of the vectors of the smallest ids; each round
assigns all parts and moves every entry to the mean of its parts.

The nearest entry is found by partial distances: dimensions are gone through in
the order of falling variance of the codebook, and a vector drops out of the
search for an entry once the distance so far is larger than the best complete
one.  All numbers are whole, so the result does not depend on any order.

A round is one pass: tasks sum up their own vectors, Spark adds the sums up by
entry, and the driver sees the codebooks alone (entries times dimensions).

Defined results: vectors that are null or hold null or non-finite components are
dropped; components beyond ``BOUND`` are held there, so that no sum overflows;
the length of the most vectors (the larger one of equals) is that of the
codebooks, and vectors of another length have null for code and errors; lengths
that the number of parts does not divide are filled up with zeros; of fewer
vectors than entries, there are as many entries; equal ids are told apart by
their vectors, null ids come last and have rows like others; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.llm.shared import release, written

#: Largest absolute whole number of a component.
BOUND = 1 << 24
#: Vectors that are assigned at once.
ROWS = 4096
#: Sums of so many labels, counted first, are sent to all tasks.
FEW_LABELS = 10_000


@dataclass(frozen=True)
class Codebooks:
    """Entries (parts x entries x dimensions of a part) for vectors of ``dim`` components."""

    values: np.ndarray
    dim: int

    def sha256(self) -> str:
        """Of all components by part, entry and place, as decimal numbers."""
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()


def finite(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there and holds numbers throughout."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~F.exists(F.col(vector), bad))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, within the bound."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -BOUND, BOUND).astype(np.int64)


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry of a codebook (entries x dimensions), the lower
    one of equals, and its squared distance, for vectors as columns (dimensions x vectors)."""
    n = columns.shape[1]
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    best, at = ((columns - book[0][:, None]) ** 2).sum(axis=0), np.zeros(n, np.int64)
    for k in range(1, len(book)):
        alive, total = None, np.zeros(n, np.int64)
        for j in order:
            apart = (columns[j] if alive is None else columns[j][alive]) - book[k, j]
            total = total + apart * apart
            stay = total <= (best if alive is None else best[alive])
            if not stay.all():
                alive, total = np.flatnonzero(stay) if alive is None else alive[stay], total[stay]
                if not len(alive):
                    break
        alive = np.arange(n) if alive is None else alive
        closer = total < best[alive]
        best[alive[closer]], at[alive[closer]] = total[closer], k
    return at, best


def _blocks(column: pa.Array, dim: int, parts: int, scale: int) -> Iterator[np.ndarray]:
    """Vectors of ``dim`` components as columns of whole numbers, so many at once, filled up."""
    for first in range(0, len(column), ROWS):
        values = column.slice(first, ROWS).flatten().to_numpy(zero_copy_only=False)
        block = whole(values, scale).reshape(-1, dim) if dim else np.zeros((len(column.slice(first, ROWS)), 0), np.int64)
        yield np.pad(block, ((0, 0), (0, -dim % parts))).T.copy()


def learn(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, key: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks after that many rounds; None without vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    kept = finite(vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")), "v")
    lengths = kept.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return None
    dim, size = lengths["dim"], -(-lengths["dim"] // parts)
    same = kept.where(F.size("v") == dim)
    first = same.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # as many rows as entries
    start = whole(np.array([r["v"] for r in first], np.float64).reshape(len(first), dim), scale)
    books = np.pad(start, ((0, 0), (0, -dim % parts))).reshape(len(first), parts, size).transpose(1, 0, 2).copy()
    only = same.select("v")
    for _ in range(rounds if dim else 0):

        def run(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                for block in _blocks(batch.column(0), dim, parts, scale):
                    for p in range(parts):
                        part = block[p * size : (p + 1) * size]
                        at, _ = nearest(part, books[p])
                        count[p] += np.bincount(at, minlength=len(books[p]))
                        for j in range(size):  # sums of a block are exact as 64-bit floats
                            total[p, :, j] += np.bincount(at, part[j], len(books[p])).astype(np.int64)
            p, k = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, k, count[p, k])] + [pa.array(total[p, k].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])
            release()

        sums = only.mapInArrow(run, "part long, entry long, n long, total array<long>")
        added = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(size)])
        moved = books.copy()
        for part, entry, n, *total in added.collect():  # one row an entry that is used
            moved[part, entry] = np.array(total, np.int64) // n
        books = moved
    return Codebooks(books, dim)


def encode(vectors: DataFrame, books: Codebooks | None, scale: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error): two hexadecimal digits a part, and the squared
    distances of all parts together."""
    kept = finite(vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v")), "v")
    kinds = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    if books is None:
        return kept.sparkSession.createDataFrame([], kinds)
    dim, (parts, _, size) = books.dim, books.values.shape
    digits = np.array([f"{k:02x}" for k in range(256)], "U2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            fits = np.flatnonzero(np.diff(column.offsets.to_numpy()) == dim)
            codes, errors = np.full(len(column), None, object), np.full(len(column), None, object)
            done = 0
            for block in _blocks(column.take(pa.array(fits)), dim, parts, scale):
                n = block.shape[1]
                rows = fits[done : done + n]
                code, error = np.full(n, "", f"U{2 * parts}"), np.zeros(n, np.int64)
                for p in range(parts):
                    at, far = nearest(block[p * size : (p + 1) * size], books.values[p])
                    code, error = np.char.add(code, digits[at]), error + far
                codes[rows], errors[rows] = code, error
                done += n
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes.tolist(), pa.string()), pa.array(errors.tolist(), pa.int64())], ["vec_id", "label", "code", "error"])
        release()

    return kept.mapInArrow(run, kinds)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector, under
    codebooks learned from all of them; ``label_error`` is the error of all vectors
    of the same label together, nulls being one label."""
    books = learn(vectors, parts, entries, rounds, scale, key, vector)
    coded = written(encode(vectors, books, scale, key, vector, label), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    few = coded.select("label").distinct().limit(FEW_LABELS + 1).count() <= FEW_LABELS
    both = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit("" if books is None else books.sha256()).alias("codebooks_sha256"))
