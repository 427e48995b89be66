"""The network: gradients, training in tasks, what it learns, and its transfer."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tetrad.operators import neural

SCHEMA = "lang string, a string, b string, c string, d string, valid boolean"


def made(seed, lang, ending, letters, n=250):
    """Pairs of stems with an ending; what does not hold has the ending's letters elsewhere, so characters balance."""
    r = random.Random(seed)
    stem = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 4)))
    out = []
    for _ in range(n):
        x, y = stem(), stem()
        out += [(lang, x, x + ending, y, y + ending, True), (lang, x, x + ending, y, ending + y, False)]
    return out


def test_gradients_are_those_of_the_loss():
    net = neural.Network.fresh(list("abcde"), 1)
    quads, truth = [("ab", "abc", "b", "bc"), ("a", "abcde", "eed", "x"), ("", "a", "b", "c")], np.array([1.0, 0.0, 1.0])
    gradient, loss = net.gradient(quads, truth)
    flat, rng = net.flat(), np.random.default_rng(0)
    assert loss > 0 and len(gradient) == len(flat)
    for i in rng.choice(len(flat), 80, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        measured = (net.with_flat(flat + step).gradient(quads, truth)[1] - net.with_flat(flat - step).gradient(quads, truth)[1]) / 2e-5
        assert abs(measured - gradient[i]) < 1e-4 * max(1, abs(measured))


def test_words_have_a_begin_an_end_and_strangers():
    e = neural.Embedding.fresh(list("abc"), np.random.default_rng(0))
    ids, lengths = e.encode(["ab", "", "cxd"])
    assert ids.tolist() == [[3, 0, 1, 4, -1, -1], [3, 4, -1, -1, -1, -1], [3, 2, 5, 5, 4, -1]] and lengths.tolist() == [4, 2, 5]
    alone, together = e.forward(["ab"])[0], e.forward(["ab", "abcabcabcabc"])[0]
    assert np.allclose(alone[0], together[0])  # what stands beside a word does not matter


def test_batches_are_summed_over_tasks(spark):
    """One step over one batch is the plain gradient's step, however rows are dealt."""
    rows = made(1, "x", "en", "bdfg", 40)
    quads = spark.createDataFrame(rows, SCHEMA)
    found = [neural.train(quads.repartition(n), steps=2, batch=10_000) for n in (1, 5)]
    assert [f.losses["x"] for f in found][0] == pytest.approx(found[1].losses["x"], abs=1e-6)
    net = neural.Network.fresh(sorted({c for r in rows for w in r[1:5] for c in w}), 0)
    turned = [neural._turned(r[1:5], 0) for r in rows]
    gradient, loss = net.gradient(turned, np.array([float(r[5]) for r in rows]))
    assert found[0].losses["x"][0] == pytest.approx(loss / len(rows), abs=1e-6)
    moved = net.flat() - neural.Adam(0.01, np.zeros_like(gradient), np.zeros_like(gradient)).step(gradient / len(rows))
    one = neural.train(quads, steps=1, batch=10_000).networks["x"].flat()
    assert np.abs(one - moved).max() < 1e-3


def test_learns_order_and_transfers(spark, tmp_path):
    rows = made(1, "one", "en", "bdfgai") + made(2, "two", "us", "klmpou")
    held = spark.createDataFrame(made(3, "one", "en", "bdfgai", 100) + made(4, "two", "us", "klmpou", 100), SCHEMA)
    quads = spark.createDataFrame(rows, SCHEMA).repartition(3)
    trained = neural.train(quads, steps=40, batch=128)
    again = neural.train(quads, steps=40, batch=128)
    for lang in ("one", "two"):
        losses = trained.losses[lang]
        assert np.mean(losses[-5:]) < 0.3 * np.mean(losses[:5]) and losses == again.losses[lang]
    full = {tuple(r)[:2]: tuple(r)[2:] for r in neural.matrix(trained, held).collect()}
    assert set(full) == {(m, d) for m in ("one", "two") for d in ("one", "two")}
    assert all(min(full[x, x]) > 0.9 for x in ("one", "two"))
    assert full["one", "two"][2] < full["two", "two"][2]
    partial = {tuple(r)[:2]: tuple(r)[2:] for r in neural.matrix(trained, held, "partial").collect()}
    assert set(partial) == set(full) and all(partial[x, x] == full[x, x] for x in ("one", "two"))
    # another language's classifier says other things of the data's own vectors than of its own
    quad, nets = [("bag", "bagen", "fab", "faben")], trained.networks
    own, behind = neural.judged(nets["one"].embedding, [nets["one"].classifier, nets["two"].classifier], quad)
    assert own[0] > 0.5 and behind[0] != neural.judged(nets["two"].embedding, [nets["two"].classifier], quad)[0][0]
    for cell in full.values():
        assert cell[2] == pytest.approx((cell[0] + cell[1]) / 2, abs=1e-5)  # as many hold as do not
    trained.save(spark, str(tmp_path / "model"))
    back = neural.Trained.load(spark, str(tmp_path / "model"))
    assert back.losses == trained.losses and {tuple(r)[:2]: tuple(r)[2:] for r in neural.matrix(back, held).collect()} == full
    with pytest.raises(ValueError):
        neural.matrix(back, held, "half")


def test_one_network_for_all_languages_and_odd_rows(spark):
    rows = [*made(5, "one", "en", "bdfg", 60), *made(6, "two", "us", "klmp", 60), ("one", None, "", "long" * 100, "x", False)]
    quads = spark.createDataFrame(rows, SCHEMA)
    omni = neural.train(quads.withColumn("lang", F.lit("all")), steps=3)
    assert list(omni.networks) == ["all"] and set("bdfgklmp") <= set(omni.networks["all"].embedding.letters)
    found = neural.matrix(omni, quads).collect()
    assert {(r["model_lang"], r["data_lang"]) for r in found} == {("all", "one"), ("all", "two")}
    assert neural.matrix(omni, quads, "partial").count() == 0  # no embedding of the data's languages
    none = neural.train(quads.limit(0), steps=2)
    assert none.networks == {} and neural.matrix(none, quads).count() == 0 and neural.matrix(omni, quads.limit(0)).count() == 0
