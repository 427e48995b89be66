"""Vector codes against a plain version of themselves."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tetrad.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, v int, _label string"


def plain(rows, parts=8, entries=16, rounds=6):
    """The same by loops over whole numbers; rows of (vec_id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in kept]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    same = [(i, v + [0] * (-dim % parts), y) for i, v, y in kept if len(v) == dim]
    size = len(same[0][1]) // parts
    first = sorted(same, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * size : (p + 1) * size] for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v, _ in same:
                of.setdefault(near(v[p * size : (p + 1) * size], books[p])[1], []).append(v[p * size : (p + 1) * size])
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, y in kept:
        if len(v) != dim:
            out.append([i, None, None, y, sha])
            continue
        v = v + [0] * (-dim % parts)
        found = [near(v[p * size : (p + 1) * size], books[p]) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y, sha])
    total = {}
    for _, _, e, y, _ in out:
        total[y] = total.get(y) if e is None else (total.get(y) or 0) + e
    return sorted(((i, c, e, total[y], s) for i, c, e, y, s in out), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "z") for r in rows], SCHEMA).repartition(4)


def made(seed, n, dim):
    r = random.Random(seed)
    centre = [[r.gauss(0, 0.2) for _ in range(dim)] for _ in range(12)]
    return [(i, [float(np.float32(c + r.gauss(0, 0.05))) for c in centre[i % 12]], i % 5) for i in range(n)]


def test_codes(spark):
    rows = made(1, 300, 16)
    rows += [(400, None, 1), (401, [None] + [0.0] * 15, 1), (402, [float("nan")] + [0.0] * 15, 2), (403, [float("inf")] + [0.0] * 15, 2), (404, [0.5] * 7, 3), (405, [], None), (406, [0.25] * 16, None), (None, [0.75] * 16, None)]
    rows += [rows[0], (0, [-0.5] * 16, 4)]  # a repeated row, and an id of another vector
    got = sorted(map(tuple, codes.compress(frame(spark, rows)).collect()), key=repr)
    assert got == plain(rows)
    assert codes.compress(frame(spark, rows)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_few_vectors_odd_lengths_and_none(spark):
    for rows in (made(2, 5, 24), made(3, 60, 13), [(1, [1e30, -1e30, 0.0], None)] * 3):
        if rows[0][1][0] == 1e30:  # held at the bound
            got = codes.compress(frame(spark, rows)).collect()
            assert [(x["code"], x["error"], x["label_error"]) for x in got] == [("00" * 8, 0, 0)] * 3
            continue
        assert sorted(map(tuple, codes.compress(frame(spark, rows)).collect()), key=repr) == plain(rows)
    assert codes.compress(frame(spark, [])).count() == 0
    assert codes.compress(frame(spark, [(1, None, 2)])).count() == 0


def test_nearest_is_exact_whatever_is_dropped():
    r = np.random.default_rng(4)
    for k, dim in ((1, 3), (16, 8), (40, 5)):
        book, x = r.integers(-50, 50, (k, dim)), r.integers(-50, 50, (dim, 3000))
        full = ((x.T[:, None, :] - book[None]) ** 2).sum(axis=2)
        at, far = codes.nearest(x, book)
        assert (at == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()
    flat = np.zeros((4, 5), np.int64)  # all entries alike: the first one
    assert (codes.nearest(np.zeros((5, 7), np.int64), flat)[0] == 0).all()


def test_many_labels_are_joined(spark, monkeypatch):
    rows = [(i, v, i // 2 if i % 7 else None) for i, v, _ in made(5, 100, 8)]
    want = plain(rows)
    monkeypatch.setattr(codes, "FEW_LABELS", 3)
    assert sorted(map(tuple, codes.compress(frame(spark, rows)).collect()), key=repr) == want
    bad = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted(map(tuple, codes.compress(bad).collect()), key=repr) == want
