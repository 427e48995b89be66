"""Column expressions on words: characters, multisets, distances, codes.

All are built-in expressions, so they stay in the JVM; characters are code
points and nothing is normalised.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chars(word: Column | str) -> Column:
    """The word's characters; the empty word has none."""
    word = _c(word)
    return F.when(F.length(word) == 0, F.array().cast("array<string>")).otherwise(F.split(word, ""))


def char_count(word: Column | str, char: Column | str) -> Column:
    """How often a single character occurs, taken literally."""
    word = _c(word)
    return F.length(word) - F.length(F.replace(word, _c(char), F.lit("")))


def char_vector(word: Column | str, alphabet: Sequence[str]) -> Column:
    """Counts of the alphabet's characters, in its order."""
    return F.array(*[char_count(word, F.lit(a)) for a in alphabet]) if alphabet else F.array().cast("array<int>")


def token_vector(word: Column | str, tokens: Sequence[str], delimiter: str = " ") -> Column:
    """Counts of whole tokens between delimiters."""
    parts = F.split(_c(word), "\\Q" + delimiter + "\\E")
    return F.array(*[F.size(F.filter(parts, lambda x: x == F.lit(t))) for t in tokens]) if tokens else F.array().cast("array<int>")  # noqa: B023


def bit_vector(word: Column | str, ranks: dict[str, int]) -> Column:
    """Sum over the word's characters of the 8 bits of their rank's code, lowest
    bit first; codes are the bytes in order of their number of set bits."""
    codes = sorted(range(256), key=lambda b: (b.bit_count(), b))
    table = F.create_map(*[F.lit(x) for c, r in ranks.items() for x in (c, codes[r])]) if ranks else F.create_map().cast("map<string,int>")
    code = F.transform(chars(word), lambda c: F.coalesce(F.element_at(table, c), F.lit(0)))
    bit = lambda k: F.aggregate(code, F.lit(0), lambda s, x: s + F.shiftright(x, k).bitwiseAND(1))
    return F.array(*[bit(k) for k in range(8)])


def alphagram(word: Column | str) -> Column:
    """The word's letters in order."""
    return F.array_join(F.array_sort(chars(word)), "")


def multiset(word: Column | str) -> Column:
    """Sorted characters with repeats, a form of the multiset that can be compared."""
    return F.array_sort(chars(word))


def multiset_minus(a: Column | str, b: Column | str) -> Column:
    """Characters of a beyond those of b, as sorted text with repeats."""
    a, b = chars(a), chars(b)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    extra = F.transform(F.array_sort(F.array_distinct(a)), lambda x: F.repeat(x, F.greatest(count(a, x) - count(b, x), F.lit(0))))
    return F.array_join(extra, "")


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence, by rows of the usual table."""
    x, y = chars(a), chars(b)
    places = F.when(F.size(y) > 0, F.sequence(F.lit(1), F.size(y))).otherwise(F.array().cast("array<int>"))
    first = F.transform(F.concat(F.array(F.lit(0)), places), lambda _: F.lit(0))

    def row(above: Column, c: Column) -> Column:
        step = lambda done, j: F.concat(done, F.array(F.when(F.get(y, j - 1) == c, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(done, j - 1), F.get(above, j)))))
        return F.aggregate(places, F.array(F.lit(0)), step)

    return F.element_at(F.aggregate(x, first, row), -1)


def lcs_distance(a: Column | str, b: Column | str) -> Column:
    """Insertions and deletions between two words: |a| + |b| - 2 lcs.  (An edit
    distance with substitutions is something else.)"""
    return (F.length(_c(a)) + F.length(_c(b)) - 2 * lcs_length(a, b)).cast("int")


def lcs(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_distance_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same distance for long words, where the expression's table is slow."""
    return pd.Series([None if x is None or y is None else len(x) + len(y) - 2 * lcs(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def covers(a: Column | str, b: Column | str, c: Column | str) -> Column:
    """Every character of a occurs in b and c together often enough."""
    a, both = chars(a), F.concat(chars(b), chars(c))
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.forall(F.array_distinct(a), lambda x: count(a, x) <= count(both, x))


def characters_balance(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """a and d together have the characters of b and c together."""
    return F.array_sort(F.concat(chars(a), chars(d))) == F.array_sort(F.concat(chars(b), chars(c)))


def distances_balance(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """d(a,b) = d(c,d) and d(a,c) = d(b,d)."""
    return (lcs_distance(a, b) == lcs_distance(c, d)) & (lcs_distance(a, c) == lcs_distance(b, d))


def valid_analogy(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    return characters_balance(a, b, c, d) & distances_balance(a, b, c, d)


def trivial_analogy(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    a, b, c, d = map(_c, (a, b, c, d))
    return ((a == b) & (c == d)) | ((a == c) & (b == d))


def common_rest(a: Column | str, b: Column | str) -> Column:
    """Whether what is left of both words is the same text, once characters that
    they do not share equally often are taken out."""
    x, y = chars(a), chars(b)
    count = lambda xs, c: F.size(F.filter(xs, lambda z: z == c))
    shared = F.filter(F.array_intersect(x, y), lambda c: count(x, c) == count(y, c))
    left = lambda xs: F.array_join(F.filter(xs, lambda c: F.array_contains(shared, c)), "")
    return left(x) == left(y)


def encode(word: Column | str, vocabulary: Sequence[str], marks: bool = False) -> Column:
    """Character ids, -1 for unknown ones; with marks, the begin and end ids
    (size and size + 1 of the vocabulary) around them."""
    voc = F.array(*[F.lit(c) for c in vocabulary])
    ids = F.transform(chars(word), lambda c: F.coalesce(F.array_position(voc, c), F.lit(0)).cast("bigint") - 1)
    return F.concat(F.array(F.lit(len(vocabulary)).cast("bigint")), ids, F.array(F.lit(len(vocabulary) + 1).cast("bigint"))) if marks else ids


def decode(ids: Column | str, vocabulary: Sequence[str]) -> Column:
    """The word of some ids; ids outside the vocabulary stand for nothing."""
    voc = F.array(*[F.lit(c) for c in vocabulary])
    return F.array_join(F.transform(_c(ids), lambda i: F.when((i >= 0) & (i < len(vocabulary)), F.get(voc, i.cast("int")))), "")


def is_ascii(word: Column | str) -> Column:
    return _c(word).rlike(r"^[\x00-\x7F]*$")


def mask_non_ascii(word: Column | str, mask: str = "?") -> Column:
    return F.regexp_replace(_c(word), r"[^\x00-\x7F]", mask)


def utf8_size(word: Column | str) -> Column:
    return F.octet_length(_c(word))


def duration(seconds: Column | str) -> Column:
    """h:mm:ss"""
    s = _c(seconds).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def truth(text: Column | str) -> Column:
    """Boolean words; NULL for other text."""
    low = F.lower(_c(text))
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False)
