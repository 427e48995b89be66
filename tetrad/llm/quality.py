"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Rolling hashes of several n-gram lengths and of lines are computed with numpy
over blocks of whole texts; characters inside an n-gram or line that occurs
more than once in its text count as covered.

Defined results: null, empty and blank texts have no words and fail the base
rule; texts of any length are read whole; repeated rows are judged alike, one
result each; extra columns are ignored by ``measure`` and kept by ``keep``;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.llm import kernels as K
from tetrad.llm.shared import blocks, small_batches, text_bytes, texts

#: Symbols that the base counts.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Largest share of a text's word characters inside repeated n-grams (by n)
    or inside repeated lines, and the least number of words."""

    ngrams: tuple[tuple[int, float], ...] = ((4, 0.40), (6, 0.34), (10, 0.28))
    lines: float = 0.30
    min_words: int = 50
    symbols_per_word: float = 0.25


def _block(data: np.ndarray, offsets: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    inside = ~K.WHITE[data]
    starts, ends = K.spans(inside, offsets)
    owner = K.owners(starts, offsets)
    words = K.hashes(data, starts, ends)
    lead = (data & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    points = np.concatenate([[0], np.cumsum(lead)])
    chars = points[ends] - points[starts]
    n_words = np.bincount(owner, minlength=n)
    word_chars = K.sums(chars, owner, n)

    line_starts, line_ends = K.spans(data != 10, offsets)
    with_word = np.zeros(len(line_starts), bool)
    if len(starts):
        with_word[np.searchsorted(line_starts, starts, "right") - 1] = True
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_owner = K.owners(line_starts, offsets)
    line_key = K.mix(K.hashes(data, line_starts, line_ends) + line_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    dup_line = K.seen_before(line_key)
    n_dup_lines = K.sums(dup_line, line_owner, n)
    in_line = np.zeros(len(starts) + 1, np.int64)
    both = K.repeated(line_key)
    np.add.at(in_line, np.searchsorted(starts, line_starts[both]), 1)
    np.add.at(in_line, np.searchsorted(starts, line_ends[both]), -1)
    line_chars = K.sums(chars * (np.cumsum(in_line[:-1]) > 0), owner, n)

    salt, rolling = K.mix(owner.astype(np.uint64) + np.uint64(77)), K.Rolling(words)

    def covered(size: int) -> np.ndarray:
        """Words inside n-grams of this size that occur twice or more in their text."""
        count = len(words) - size + 1
        out = np.zeros(len(words) + 1, np.int64)
        if count > 0:
            whole = owner[:count] == owner[size - 1 :]
            at = np.flatnonzero(whole)
            grams = (rolling(size) ^ salt[:count])[at]
            at = at[K.repeated(grams)]
            out[at] += 1
            out[at + size] -= 1
        return np.cumsum(out[:-1]) > 0

    n_repeat_words = K.sums(covered(3), owner, n)
    shares = {f"coverage_{size}": K.sums(chars * covered(size), owner, n) / np.maximum(word_chars, 1) for size, _ in limits.ngrams}
    shares["coverage_lines"] = line_chars / np.maximum(word_chars, 1)
    n_symbols = np.bincount(text_of[symbol[data]], minlength=n)
    failed = (n_words < limits.min_words) | (100 * n_repeat_words > 50 * n_words)
    good = (n_symbols <= limits.symbols_per_word * n_words) & (shares["coverage_lines"] <= limits.lines)
    for size, most in limits.ngrams:
        good &= shares[f"coverage_{size}"] <= most
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "base_failed": failed,
        "kept": ~failed & good,
        **shares,
    }


def _columns(limits: Limits) -> list[tuple[str, str]]:
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return [(c, "long") for c in longs] + [("base_failed", "boolean"), ("kept", "boolean")] + [(f"coverage_{n}", "double") for n, _ in limits.ngrams] + [("coverage_lines", "double")]


_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def _measured(batch: pa.RecordBatch, text: str, limits: Limits) -> list[pa.Array]:
    data, offsets = text_bytes(batch.column(text).fill_null(""))
    parts = [_block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], limits) for a, b in blocks(offsets)]
    return [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], _ARROW[t]) for c, t in _columns(limits)]


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The key with the counts, coverages and verdict of each text."""
    small_batches(docs.sparkSession)
    names = [c for c, _ in _columns(limits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_measured(batch, "text", limits)], [key, *names])

    source = texts(docs, key, text=text)
    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} {t}" for c, t in _columns(limits)))


def keep(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows whose text is kept, with all their columns; nothing is shuffled."""
    small_batches(docs.sparkSession)
    verdict = [c for c, _ in _columns(limits)].index("kept")
    whole = docs.withColumn(text, F.col(f"`{text}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_measured(batch, text, limits)[verdict])

    return whole.mapInArrow(run, whole.schema)
