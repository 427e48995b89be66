"""Heavily disguised words are decoded, figures and plain words stay."""

import random

import pytest

from tetrad.llm.toxicity import BETWEEN, CLASSES, LEET, Channel, letter_class

WORDS = "idiot losers worthless stupid shit moron dimwit fool letter better hello the of and".split()


@pytest.fixture(scope="module")
def channel():
    counted = {}
    for w in WORDS:
        c = [0, 0, *map(letter_class, w), 0]
        for k in range(len(c) - 2):
            n = (c[k] * CLASSES + c[k + 1]) * CLASSES + c[k + 2]
            counted[n] = counted.get(n, 0) + 500
    return Channel.of(list(counted.items()))


@pytest.mark.parametrize(
    ("shown", "meant"),
    [("1d10t", "idiot"), ("l053rs", "losers"), ("w0r7h1355", "worthless"), ("5h17", "shit"), ("i..d..i..o..t", "idiot"), ("stu" + 50 * "u" + "pid", "stupid"), ("mmoorroonn", "moron")],
)
def test_disguised(channel, shown, meant):
    assert channel.restore(shown) == meant


@pytest.mark.parametrize("plain", ["letter", "2024", "10:30", "hello", "3.14", "1,000"])
def test_plain(channel, plain):
    assert channel.restore(plain) == plain


def test_three_spaced_letters(channel):
    assert channel.words("a s s here") == ["ass", "here"]


def test_long_token_in_linear_time(channel):
    import time

    began = time.time()
    assert channel.restore("sh1t" * 5000) == "shit" * 5000
    assert time.time() - began < 10


def every_way(token):
    """All (word, price) that the token may stand for, without the language model."""
    ways, run = [("", 0.0)], 0
    for k, c in enumerate(token):
        run = run + 1 if k and token[k - 1] == c else 1
        if c.isalpha():
            options = [(c, 6.0 if run >= 3 else 0.0)] + ([("", 1.0 + (2.0 if run == 2 else 0.2))] if run > 1 else [])
        else:
            options = [(x, 1.5) for x in LEET.get(c, "")] + ([("", 1.7)] if c in BETWEEN else []) or [("", 4.0)]
        ways = [(word + x, price + more) for word, price in ways for x, more in options]
    return ways


def test_decoded_is_the_cheapest_of_all_ways(channel):
    """Viterbi against an enumeration of the whole lattice."""
    r = random.Random(6)

    def price(word):
        c = [0, 0, *map(letter_class, word), 0]
        return sum(float(channel.cost[c[k], c[k + 1], c[k + 2]]) for k in range(len(c) - 2))

    marks = "".join(LEET) + "".join(BETWEEN)
    for _ in range(300):
        word = r.choice(WORDS)[:7]
        token = "".join(c if r.random() < 0.6 else r.choice([c + c, r.choice(marks), c + r.choice(marks), c * 3]) for c in word)[:9]
        cost = {}
        for meant, noise in every_way(token):
            cost[meant] = min(cost.get(meant, float("inf")), noise + price(meant))
        got = channel.decode(token)
        assert cost[got] <= min(cost.values()) + 1e-4, (token, got, min(cost, key=cost.get))
