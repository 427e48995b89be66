"""Every link of the Jaccard join, against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from tetrad.llm import jaccard, queries
from tests.llm.test_operators import ROWS, plain_classes, shingle_sets


def plain_links(rows):
    s = shingle_sets(rows)
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= 75 * len(a | b)
    n = [sum(linked(s[i], s[j]) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    return Counter((rows[i][0], n[i]) for i in range(len(rows)))


@pytest.mark.parametrize("share", [512, 3])
def test_links_within_components(spark, tmp_path, monkeypatch, share):
    """Chains whose ends are not linked, near copies, exact copies: each row's number of links."""
    monkeypatch.setattr(jaccard, "SHARE", share)
    monkeypatch.setattr(jaccard, "WIDTH", 64)
    r = random.Random(11)
    rows = [(i, t) for i, t in ROWS[:9]]
    for n in (30, 120):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for _ in range(12):
            base = [*base[max(1, n // 20) :], *[f"w{r.randrange(10**6)}" for _ in range(max(1, n // 20))]]
            rows += [(100 + len(rows), " ".join(base))] * r.choice([1, 1, 3])
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_ngram_jaccard_join(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    got = got.collect()
    assert Counter((x["doc_id"], x["n_links"]) for x in got) == plain_links(rows)
    assert Counter(tuple(x)[:3] for x in got) == plain_classes(rows)
    group = {}
    for x in got:
        group.setdefault(x["component_id"], []).append(x["n_links"])
    assert any(min(v) < len(v) - 1 for v in group.values())


def test_shuffles_go_before_the_next_step(spark, tmp_path, monkeypatch):
    """After the sets are stored and after each comparison of pairs, shuffle files are let go before anything else is written."""
    steps = []
    write, collect = jaccard.written, jaccard.collect_garbage
    monkeypatch.setattr(jaccard, "written", lambda df, name: steps.append(name) or write(df, name))
    monkeypatch.setattr(jaccard, "collect_garbage", lambda s: steps.append("-") or collect(s))
    words = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(words)), (1, " ".join(words[1:])), (2, "other words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    queries.op8_ngram_jaccard_join(spark, str(tmp_path)).collect()
    assert steps[steps.index("set-store") + 1] == "-" and steps[steps.index("links") + 1] == "-"


def test_filter_lets_few_others_through(spark):
    """Sets that cannot be linked are stored only where the filter takes them for others: few, and no larger a share of more rows."""
    keys = np.random.default_rng(3).integers(1, 1 << 62, 60_000)
    own, others = keys[:20_000].astype(np.uint64), keys[20_000:].astype(np.uint64)
    bits = jaccard._wanted(spark.createDataFrame([(k,) for k in keys[:20_000].tolist()], "k long"))
    assert jaccard._passes(bits, own).all()
    assert jaccard._passes(bits, others).mean() < 0.01
    assert not jaccard._passes(bits, np.zeros(1, np.uint64)).any()
