"""Solving and verifying word analogies a : b :: c : d.

A solution is an alignment of the four words, read from its columns.  Each
character of a is found again in b, in c, or in both; a column is one of

    all four words      a = b = c, d gets it
    a and b             a's character is missing in c, and so in d
    a and c             a's character is missing in b, and so in d
    b alone, c alone    a character that d gets too
    a and c against b   c's character takes the place that b's has, d gets b's
    a and b against c   b's character takes the place that c's has, d gets c's

so what changes from a to b changes from c to d, and what changes from a to c
from b to d.  d is what an alignment of the fewest columns other than those of
all four words spells; of equal ones, the one that is preferred column by column
from the right end (``_columns``).

The edit distances of all prefixes of a and b, and of a and c, bound what is
left from below: a column that costs anything costs in one of them only.  The
search goes down no way that the bound forbids, and raises its limit until an
alignment is found; what has failed once is not tried again.  So the alignment
is the best of all, whatever the lengths.

If b and c are the same word, it is read in one way only, so a must be in it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

State = tuple[int, int, int]
#: The next state, what d gets, and the cost.
Column = tuple[State, str, int]


def _distances(a: str, b: str) -> list[list[int]]:
    """Edit distances of all prefixes, replacements costing as much as one insertion."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        above, row = rows[-1], [i]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] if x == y else 1 + min(above[j - 1], above[j], row[-1]))
        rows.append(row)
    return rows


def _columns(a: str, b: str, c: str, state: State) -> list[Column]:
    """The last columns that an alignment of the prefixes may have, the preferred first.

    A character of a that is in both words is shared.  If it is in one of them,
    the other word is read on in search of it, and if it is in neither, the one
    that has it further on.  What stands before a's first character comes from
    b, then from c.
    """
    i, j, k = state
    x = a[i - 1] if i else None
    y, z = b[j - 1] if j else None, c[k - 1] if k else None
    in_b, in_c = i > 0 and x == y, i > 0 and x == z
    from_b: list[Column] = [((i, j - 1, k), y, 1)] if j else []
    from_c: list[Column] = [((i, j, k - 1), z, 1)] if k else []
    if in_b and in_c:
        return [((i - 1, j - 1, k - 1), x, 0), *from_c, *from_b, ((i - 1, j - 1, k), "", 1), ((i - 1, j, k - 1), "", 1)]
    if in_b:
        return [*from_c, ((i - 1, j - 1, k), "", 1), *([((i - 1, j - 1, k - 1), z, 1)] if k else []), *from_b]
    if in_c:
        return [*from_b, ((i - 1, j, k - 1), "", 1), *([((i - 1, j - 1, k - 1), y, 1)] if j else []), *from_c]
    c_first = i == 0 or (x in c[:k] and x not in b[:j])
    return [*from_c, *from_b] if c_first else [*from_b, *from_c]


def _found_again(a: str, b: str, c: str) -> bool:
    """Whether b and c together hold a's characters in order: for each suffix of
    a, the places of b and c that are left, as far as none is better than another."""
    left = [(len(b), len(c))]
    for x in reversed(a):
        after = {(b.rfind(x, 0, j), k) for j, k in left} | {(j, c.rfind(x, 0, k)) for j, k in left}
        left, most = [], -1
        for j, k in sorted((p for p in after if min(p) >= 0), reverse=True):
            if k > most:
                left.append((j, k))
                most = k
        if not left:
            return False
    return True


def _reading(a: str, b: str, c: str) -> str | None:
    if Counter(a) - (Counter(b) + Counter(c)) or not _found_again(a, b, c) or (b == c and not _found_again(a, b, "")):
        return None
    ab, ac = _distances(a, b), _distances(a, c)
    start = (len(a), len(b), len(c))
    limit = ab[-1][-1] + ac[-1][-1]
    while True:
        found = _within(a, b, c, ab, ac, start, limit)
        if found is not None:
            return found
        limit += 1


def _within(a: str, b: str, c: str, ab: list[list[int]], ac: list[list[int]], start: State, limit: int) -> str | None:
    """What the first alignment of at most that cost spells, in the order of preference."""
    failed: dict[State, int] = {}
    path: list[tuple[State, int, str, Iterator[Column]]] = [(start, limit, "", iter(_columns(a, b, c, start)))]
    while path:
        state, left, _, columns = path[-1]
        if not any(state):
            return "".join(step[2] for step in path)[::-1]
        for after, x, cost in columns:
            i, j, k = after
            rest = left - cost
            if ab[i][j] + ac[i][k] <= rest and failed.get(after, -1) < rest:
                path.append((after, rest, x, iter(_columns(a, b, c, after))))
                break
        else:
            failed[state] = max(left, failed.get(state, -1))
            path.pop()
    return None


def solve(a: str, b: str, c: str) -> str | None:
    """d of a : b :: c : d, or None; the empty word is a solution like others."""
    return _reading(a, c, b) if len(c) > len(b) else _reading(a, b, c)


def verify(a: str, b: str, c: str, d: str) -> bool:
    """Whether d is what is read off b and c in their given order."""
    return _reading(a, b, c) == d


def _each(work, *columns: pd.Series) -> pd.Series:
    """``work`` for each row without nulls, once for equal rows."""
    known: dict[tuple, object] = {}
    out = []
    for row in zip(*columns, strict=True):
        if row not in known:
            known[row] = None if None in row else work(*row)
        out.append(known[row])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def solve_analogy(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return _each(solve, a, b, c)


@F.pandas_udf(T.BooleanType())
def verify_analogy(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _each(verify, a, b, c, d)


@F.pandas_udf(T.StringType())
def first_solution(equations: pd.Series) -> pd.Series:
    """The solution of the first of an array of equations [a, b, c] that has one."""
    known: dict[tuple, str | None] = {}
    out = []
    for row in equations:
        found = None
        for equation in map(tuple, row):
            if equation not in known:
                known[equation] = solve(*equation)
            found = known[equation]
            if found is not None:
                break
        out.append(found)
    return pd.Series(out, dtype=object)


def register(spark: SparkSession) -> None:
    """The functions by name, for SQL."""
    from tetrad.functions.strings import lcs_distance_arrow

    spark.udf.register("solve_analogy", solve_analogy)
    spark.udf.register("verify_analogy", verify_analogy)
    spark.udf.register("lcs_distance", lcs_distance_arrow)
