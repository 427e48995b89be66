"""Each operator against a plain version of itself on awkward rows.

The table has null and empty texts, a long one, repeated rows, ties, near
copies, shared passages, and extra columns whose names clash with results.
"""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tetrad.llm import fingerprints, html, jaccard, licenses, mixing, packing, quality, repeats, tokens, toxicity
from tetrad.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept int, length string, score string, piece long, label string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = "[^\x20\x09-\x0D]+"


def words(r, n, vocabulary=400):
    return " ".join("".join(chr(97 + (k * 7 + i) % 26) for i in range(k % 5 + 2)) + ("é" if k % 9 == 0 else "") for k in (r.randrange(vocabulary) for _ in range(n)))


def made():
    r = random.Random(5)
    passage = words(r, 60)
    base = words(r, 200)
    texts = [None, "", " \n\t ", "one", "a b c d", "A b C d", words(r, 30), words(r, 4000, 5000)]
    texts += [words(r, r.randint(20, 150)) for _ in range(12)]
    texts += [base, base, base + " tail", base.replace(" ", "\n", 3), " ".join(base.split()[:185])]
    texts += [words(r, 40) + " " + passage + " " + words(r, 40) for _ in range(4)]
    texts += ["Licensed under the Apache License, Version 2.0. gnu GENERAL public license, GNU general public license version 3. MIT License mit license", "under CC BY-NC 4.0", "say it again " * 40, "line one here\n" * 30]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, "one"), (9, texts[9])]  # repeated rows
    return rows


ROWS = made()


def frame(spark, rows=ROWS):
    langs = ["en", "de", "es", "fr"]
    return spark.createDataFrame([(i, t, langs[(i or 0) % 4], "src0", 7, 1, 0, "x", "y", 2, None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_quality(docs, empty):
    got = sorted(tuple(r)[:7] for r in quality.measure(docs).collect())
    want = []
    for i, t in ROWS:
        t = t or ""
        w = re.findall(WORD, t)
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside), failed))
    assert got == sorted(want)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    good = sorted(r["doc_id"] for r in quality.measure(docs).where("kept").collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == good and good
    assert quality.measure(empty).count() == quality.keep(empty).count() == 0


def test_quality_coverage(spark):
    """Characters inside repeated n-grams and lines, and the verdict, against a plain count."""
    r = random.Random(41)
    limits = quality.Limits()
    rows = [(i, "\n".join(" ".join(words(r, r.randint(1, 12), r.choice([5, 40, 3000])).split()) for _ in range(r.randint(1, 25)))) for i in range(60)]
    rows += [(60, "\n".join(["a b c d e f g h"] * 9)), (61, words(r, 9000, 5000)), (62, "x " * 5000)]
    for row in quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = dict(rows)[row["doc_id"]]
        w = re.findall(WORD, t)
        total = max(1, sum(map(len, w)))
        good = not row["base_failed"] and row["n_symbols"] <= limits.symbols_per_word * len(w)
        for n, most in limits.ngrams:
            grams = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            inside = {k + j for k in range(len(w) - n + 1) if grams[tuple(w[k : k + n])] > 1 for j in range(n)}
            share = sum(len(w[k]) for k in inside) / total
            assert abs(row[f"coverage_{n}"] - share) < 1e-9
            good &= share <= most
        lines = Counter(t.split("\n"))
        share = sum(len(x) for line in t.split("\n") if lines[line] > 1 for x in re.findall(WORD, line)) / total
        assert abs(row["coverage_lines"] - share) < 1e-9
        assert row["kept"] == (good and share <= limits.lines)


def test_regular_lines_are_told_apart(spark):
    """Lines whose characters change in the way that fools a polynomial modulo a power of two."""
    one = "a"
    for _ in range(12):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    got = quality.measure(spark.createDataFrame([(1, f"{one}\n{other}"), (2, f"{one}\n{one}")], "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["n_dup_lines"] for x in got} == {1: 0, 2: 1}


def test_licenses(docs, empty):
    got = sorted(tuple(r)[:6] for r in licenses.scan(docs).collect())
    phrases = {t.label: list(t.words) for t in licenses.BASE}
    want = []
    for i, t in ROWS:
        w = re.findall(licenses.WORD, (t or "").translate(LOW))
        at = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        want.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    labels = {r["labels"] for r in licenses.scan(docs).collect()}
    assert "apache,apache-2.0,gpl,gpl-3.0,mit" in labels and "cc-by,cc-by-nc" in labels
    assert licenses.scan(empty).count() == 0


def test_fingerprints(docs, empty, spark):
    got = [r.asDict() for r in fingerprints.compare_edited(docs).collect()]
    order = sorted(((-i, t or "") for i, t in ROWS))
    want = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[-i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_text = defaultdict(set)
    text = {i: t or "" for i, t in ROWS}
    for r in got:
        by_text[text[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.compare_edited(empty).count() == 0
    only = fingerprints.compare_edited(frame(spark, [(None, "abc def")])).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1


def test_syncmers(spark):
    """Links against a plain reading of whichever k-mers are chosen; likeness by them."""
    r = random.Random(31)
    base = words(r, 300, 3000)
    cjk = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(200))
    texts = [base, base + " a tail of words", "x " + base, words(r, 300, 3000), cjk, cjk[:100] + "\u4e01" + cjk[100:], "one", "one two", words(r, 19), words(r, 20), "", "ab" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    steps = fingerprints.with_anchors(rows, "text", "_a")
    got = {x["doc_id"]: x["_a"] for x in steps.collect()}
    assert all(len(v) > 0 for v in got.values())
    near = lambda a, b: len({*got[a]} & {*got[b]}) / len({*got[a]} | {*got[b]})
    assert near(0, 1) > 0.9 and near(0, 2) > 0.9 and near(0, 3) < 0.05 and near(4, 5) > 0.85
    # two links for seven symbols, whatever the length
    assert 0.2 < len(got[0]) / 300 < 0.4 and len(got[4]) > 30
    # one word more moves only the links around it
    cut = base.split()
    more = " ".join([*cut[:150], "inserted", *cut[150:]])
    one = fingerprints.with_anchors(spark.createDataFrame([(0, base), (1, more)], "doc_id long, text string"), "text", "_a").orderBy("doc_id").collect()
    assert len({*one[0]["_a"]} - {*one[1]["_a"]}) <= 10
    # which k-mers are chosen, by the definition
    syms = re.findall(r"\S{1,24}", base)
    hs = [x["h"] for x in spark.createDataFrame([(i, w) for i, w in enumerate(syms)], "i int, w string").selectExpr("i", "xxhash64(w) h").orderBy("i").collect()]
    k = fingerprints.K
    hs = [*range(k - 1), *hs, *range(k, 2 * k - 1)]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(hs, hs[1:], strict=False))], "i int, a long, b long").selectExpr("i", "xxhash64(a, b) s").orderBy("i").collect()
    s = [x["s"] for x in pairs]
    chosen = sum(min(s[i : i + 7]) in (s[i], s[i + 6]) for i in range(len(hs) - k + 1))
    assert len(got[0]) == chosen


def test_next_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    r = random.Random(1)
    ids = sorted(r.sample(range(10_000), 50)) + [10**12]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, ["text"]).collect()}
    down = ids[::-1]
    assert got == {a: str(b) for a, b in zip(down, down[1:] + down[:1], strict=True)}


def _ids(name, end):
    e = tokens.Encoder(name)
    return {i: np.array([*e.library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for i, t in ROWS}


def test_packing(docs, empty):
    rows = packing.pack(docs, "word_bpe_49k.json", capacity=512).collect()
    ids = _ids("word_bpe_49k.json", 1)
    places = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 512 * r["piece"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(ids[i]) for i, _ in ROWS)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(empty, "word_bpe_49k.json").count() == 0


def test_places_of_a_hot_length(spark):
    """A length of most pieces is dealt to shares; rows without an id or with the same one are pieces too."""
    r = random.Random(7)
    lengths = [9] * 300 + [r.randint(1, 12) for _ in range(200)]
    made = spark.createDataFrame([(None if i % 50 == 0 else i // 3, 0, 0, n, i % 2) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    places = defaultdict(list)
    for per_share in (7, 10_000):
        places.clear()
        for x in packing.place(made, 12, per_share=per_share).collect():
            places[x["sequence_id"]].append((x["offset"], x["length"]))
        assert sorted(n for p in places.values() for _, n in p) == sorted(lengths)
        for p in places.values():
            p.sort()
            assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 12
        # no fewer than the tokens need, and no more than best-fit decreasing makes
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = [b for b, full in enumerate(bins) if full + n <= 12]
            if fit:
                bins[max(fit, key=lambda b: bins[b])] += n
            else:
                bins.append(n)
        assert -(-sum(lengths) // 12) <= len(places) <= len(bins)


def test_fullest_bin_is_fullest():
    from itertools import product

    r = random.Random(2)
    for _ in range(200):
        capacity = r.randint(5, 30)
        counts = {length: r.randint(1, 3) for length in r.sample(range(1, capacity + 1), r.randint(1, min(5, capacity)))}
        lengths = sorted(counts)
        used = packing.fullest(counts, lengths, capacity)
        best = max(sum(k * n for k, n in zip(lengths, c, strict=True)) for c in product(*[range(counts[x] + 1) for x in lengths]) if c[-1] and sum(k * n for k, n in zip(lengths, c, strict=True)) <= capacity)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items()) and used[lengths[-1]]
        left = Counter(counts)
        for bin_, times in packing.plan(counts, capacity):
            assert sum(k * n for k, n in bin_.items()) <= capacity
            left.subtract({k: n * times for k, n in bin_.items()})
        assert not any(left.values())


def test_token_files(docs, empty, spark):
    folder, index = tokens.write_sequences(docs, "byte_bpe_50k.json", end_id=2, length=64, rows_per_file=7)
    got = sorted(map(tuple, tokens.read_sequences(spark, folder, index).collect()), key=lambda r: r[1])
    ids = _ids("byte_bpe_50k.json", 2)
    at, want = 0, []
    for i, _ in sorted(ROWS, key=lambda r: r[0]):
        want.append((i, at, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        at += len(ids[i])
    assert got == want
    import pyarrow as pa

    name = index.first()["file"]
    with pa.memory_map(f"{folder.removeprefix('file://')}/{name}") as f:
        file = pa.ipc.open_file(f)
        assert pa.types.is_fixed_size_list(file.schema.field("ids").type)
        first = index.where(index.file == name).orderBy("at").first()
        assert np.concatenate(tokens.read_ids(file, first["at"], first["n_tokens"])).tolist() == ids[first["doc_id"]].tolist()
    folder, index = tokens.write_sequences(empty, "byte_bpe_50k.json", end_id=2)
    assert tokens.read_sequences(spark, folder, index).count() == 0


def test_wide_ids_and_several_files(docs, spark, monkeypatch):
    monkeypatch.setattr(tokens, "FILE_IDS", 300)
    folder, index = tokens.write_sequences(docs, "byte_bpe_50k.json", end_id=70_000, length=64)
    ids = _ids("byte_bpe_50k.json", 70_000)
    got = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read_sequences(spark, folder, index).collect()}
    assert got == {(i, len(ids[i]), zlib.crc32(ids[i].tobytes())) for i, _ in ROWS}
    nulls = frame(spark, [(None, "b"), (None, "a b c"), (None, None), (2, "x"), (-1, "y z")])
    folder, index = tokens.write_sequences(nulls, "byte_bpe_50k.json", end_id=2, length=4, rows_per_file=2)
    back = sorted(tokens.read_sequences(spark, folder, index).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in back] == [None, None, None, -1, 2] and [r["start"] for r in back] == np.cumsum([0, *(r["n_tokens"] for r in back)])[:-1].tolist()
    with pytest.raises(Exception, match="16 bits"):
        tokens.write_sequences(docs, "byte_bpe_50k.json", end_id=70_000, small_ids=True)


def shingle_sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(WORD, (t or "").translate(LOW))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def plain_classes(rows):
    s = shingle_sets(rows)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 75 * len(s[i] | s[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {c: min(rows[k][0] for k in range(len(rows)) if label[k] == c) for c in set(label)}
    return Counter((rows[k][0], len(s[k]), least[label[k]]) for k in range(len(rows)))


def test_jaccard(docs, empty):
    assert Counter(map(tuple, jaccard.classes(docs).collect())) == plain_classes(ROWS)
    kept = jaccard.one_of_each(docs)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert jaccard.classes(empty).count() == jaccard.one_of_each(empty).count() == 0


def test_jaccard_near_the_limit(spark):
    """Groups of near copies of many sizes, most of them close to the limit."""
    r = random.Random(8)
    rows = []
    for n in (6, 8, 12, 20, 45, 70, 90, 130, 260):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for _ in range(7):
            own = list(base)
            for _ in range(r.randint(0, max(1, n // 28))):
                own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own[: len(own) - r.randint(0, n // 12)])))
    got = Counter(map(tuple, jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == plain_classes(rows)


def test_pigeonhole_loses_no_pair():
    """Whatever parts and deletions the larger set looks up, those of a linked pair meet."""
    rule = jaccard.Rule()
    r = np.random.default_rng(4)
    tried = two = 0
    while tried < 150:
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        lose = int(r.integers(0, len(a) // 4 + 1))
        b = np.sort(np.concatenate([r.permutation(a)[lose:], r.integers(0, 2**63, int(r.integers(0, lose + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or not rule.linked(np.int64(both), len(a), len(b)):
            continue
        tried += 1
        e = jaccard.Entries(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), rule, deletions=True)
        tops = jaccard.bands(rule, len(a))
        lower = np.searchsorted(tops, len(a)) != np.searchsorted(tops, len(b))
        own, other = (e.owner == 0) & (e.lower == lower), (e.owner == 1) & ~e.lower
        part, at = np.unique(e.part[own & ~e.less], return_index=True)
        plural = e.plural[own & ~e.less][at]
        reach = tops[np.searchsorted(tops, len(a)) - 1] if lower else len(a)
        need = np.array([rule.difference(len(a), reach) + 1])
        cost = r.random(len(part))
        step = jaccard.cheapest(np.zeros(len(part), np.int64), part, cost, np.where(plural, r.random(len(part)), np.inf), need)
        assert step.sum() >= need[0] and not (step[~plural] > 1).any()
        two += (step > 1).sum()
        looked = lambda which, least: set(e.signature[own & which & np.isin(e.part, part[step >= least])].tolist())
        parts, less = set(e.signature[other & ~e.less].tolist()), set(e.signature[other & e.less].tolist())
        assert looked(~e.less, 1) & parts or looked(~e.less, 2) & less or looked(e.less, 2) & parts
    assert two > 1000


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Near copies between the limits, and a passage that many texts share, with
    repeated n-grams; groups go over several shares."""
    monkeypatch.setattr(jaccard, "SHARE", 16)
    monkeypatch.setattr(jaccard, "HELD", 20_000)
    r = random.Random(21)
    word = lambda: f"w{r.randrange(10**6)}"
    base, passage = [word() for _ in range(90)], [word() for _ in range(45)]
    rows = []
    for _ in range(130):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = word()
        rows.append((len(rows), " ".join(own)))
    for _ in range(130):
        own = passage + [word() for _ in range(r.randint(5, 40))]
        rows.append((len(rows), " ".join(own)))
    rows += [(500 + i, " ".join([word()] * 3 * (i + 5))) for i in range(4)] + [(600 + i, "same words again " * (20 + i)) for i in range(4)]
    got = Counter(map(tuple, jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()))
    assert got == plain_classes(rows)


def test_rows_without_an_id_or_with_the_same_one(spark):
    r = random.Random(22)
    t = [words(r, 60, 3000) for _ in range(5)]
    rows = [(1, t[0]), (1, t[0]), (1, t[1]), (2, t[1]), (None, t[2]), (None, t[2]), (3, t[3]), (None, t[3]), (None, ""), (4, None), (4, None), (5, t[4]), (6, t[4] + " more")]
    df = spark.createDataFrame([(i, x, 7) for i, x in rows], "doc_id long, text string, _set_key int")
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.classes(df).collect())
    assert got == Counter({(1, 1): 3, (2, 1): 1, (None, None): 3, (3, 3): 1, (None, 3): 1, (4, 4): 2, (5, 5): 1, (6, 5): 1})
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    want = Counter([(1, t[0]), (1, t[1]), (None, t[2]), (3, t[3]), (None, ""), (4, None), (4, None), (5, t[4])])
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    looped = {a for a, b in edges if a == b}
    assert {k: v for k, v in label.items() if k in got} == got and set(label) - set(got) <= looped


def plain_repeats(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    want, left = Counter(), []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
        left.append((i, kept.decode("utf-8", "ignore")))
    return want, left


def test_repeats(docs, empty):
    got = Counter(map(tuple, repeats.spans(docs).collect()))
    want, left = plain_repeats(ROWS)
    assert got == want and sum(k[2] for k in want) > 2000
    out = repeats.remove(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == Counter((i, t, len(t)) for i, t in left)
    assert repeats.spans(empty).count() == repeats.remove(empty).count() == 0


@pytest.mark.parametrize("many", [1000, 1])
def test_repeats_of_a_frequent_passage(spark, monkeypatch, many):
    """Passages, one shorter than a window's length, in a third of the documents
    between other words, cut at random; anchors with many segments are split."""
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "BLOCK", 4000)
    monkeypatch.setattr(repeats, "FILE", 20_000)
    monkeypatch.setattr(repeats, "SORTED", 500)
    r = random.Random(12)
    passages = [words(r, n, 5000) for n in (120, 40, 33, 300)]
    rows = []
    for i in range(120):
        t = words(r, r.randint(0, 80), 5000)
        if i % 3 == 0:
            p = passages[r.randrange(4)]
            at = r.randrange(60) if i % 2 else 0
            t = f"{t}{p[at : len(p) - r.choice([0, 0, 11])]}{words(r, r.randint(0, 50), 5000)}"
        rows.append((i if i % 10 else None, t))
    rows += [(200, "ab" * 700), (201, "z" * 900), rows[3]]
    got = Counter(map(tuple, repeats.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    want, _ = plain_repeats(rows)
    assert got == want and sum(k[2] for k in want) > 10_000


def test_repeats_of_texts_without_any(spark):
    rows = [(1, "nothing here " + "".join(map(str, range(200)))), (2, "short"), (3, None)]
    got = repeats.spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["n_removed"]) for r in got.collect()} == {(1, 0), (2, 0), (3, 0)}


def test_repeats_of_a_document_above_a_block(spark):
    r = random.Random(13)
    base = "".join(f"{r.randrange(10**8):x} " for _ in range(500_000))
    part = base[1_000_000:1_000_400]
    rows = [(1, base), (2, "x?" + part + "?y")]
    assert len(base) > repeats.BLOCK
    got = {x["doc_id"]: x for x in repeats.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in (1, 2)] == [400, 400] and got[1]["kept_sha256"] == hashlib.sha256((base[:1_000_000] + base[1_000_400:]).encode()).hexdigest()


def test_mixing(docs, empty, spark):
    targets = {"en": 0.4, "de": 0.3, "es": 0.2, "fr": 0.1}
    r = random.Random(6)
    rows = [(i, " ".join(f"{lang}{r.randrange(50)}" for _ in range(r.randint(5, 60))), lang) for i in range(200) for lang in [["en", "de", "es", "fr"][min(3, i % 7)]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = mixing.mix(df, df, targets).collect()
    lang = {i: x for i, _, x in rows}
    assert sum(r["domain"] == lang[r["doc_id"]] for r in got) > 195
    total = defaultdict(float)
    for x in got:
        total[x["domain"]] += x["rate"] * x["n_tokens"]
    for k, v in targets.items():
        assert abs(total[k] / sum(total.values()) - v) < 0.02
    assert min(r["rate"] for r in got) > 0.97
    copies = Counter(r["doc_id"] for r in mixing.mixed(df, df, targets).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in got})
    odd = mixing.mix(docs, docs, targets).collect()
    assert len(odd) == len(ROWS) and all(r["rate"] == 1 for r in odd if not r["n_tokens"])
    assert mixing.mixed(docs, docs, targets).columns == docs.columns
    assert mixing.mix(empty, empty, targets).count() == mixing.mixed(empty, empty, targets).count() == 0


def test_mixing_least_squares():
    """The projected gradient against the normal equations, and a case at the floor."""
    r = np.random.default_rng(5)
    p = r.dirichlet([0.3, 0.3, 0.3], 400)
    n = r.integers(1, 50, 400)
    weights = np.array([0.2, 0.3, 0.5])

    class Frame:  # what ``fit`` asks of a table, in this process
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array(n), pa.array(p.tolist())], ["n_tokens", "p"])
            self.rows = [{"k": int(k), "v": float(v)} for b in run(iter([batch])) for k, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            return self

        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return self

        def collect(self):
            return self.rows

    for floor in (0.0, 0.9):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixing.F, "sum", lambda *_: type("C", (), {"alias": lambda *_: None})())
            steps, targets, reached, off = mixing.fit(Frame(), weights, floor)
        rate = mixing.rates(p, steps, floor)[0]
        assert off <= mixing.CLOSE and len(steps) < 60
        assert rate.min() >= floor and np.allclose((rate * n) @ p, targets, rtol=2e-4) and np.allclose(targets / targets.sum(), weights)
        assert np.allclose(reached, (rate * n) @ p)
        if not floor:
            # without a bound in the way, what is left of the gradient steps is the least change that does it
            assert np.allclose(rate - 1, p @ np.linalg.lstsq((p * n[:, None]).T @ p, targets - n @ p, rcond=None)[0], atol=5e-3) or (rate == 0).any()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing.F, "sum", lambda *_: type("C", (), {"alias": lambda *_: None})())
        steps, _, reached, off = mixing.fit(Frame(), weights, rounds=0)  # too few steps to come close: as it is
        assert steps == [] and off > mixing.LOOSE and np.allclose(reached, n @ p)
        p[:] = 1 / 3  # domains that are not told apart
        steps, _, reached, off = mixing.fit(Frame(), weights)
        assert steps == [] and off > mixing.LOOSE and np.allclose(reached, n.sum() / 3)


def test_mixing_of_domains_that_are_not_known(spark):
    """Without labels, or of texts that do not tell the domains apart, nothing is mixed."""
    r = random.Random(8)
    rows = [(i, words(r, 30), "en" if i % 3 else "de") for i in range(120)]
    plain = "doc_id long, text string, lang string"
    targets = {"en": 0.2, "de": 0.8}
    for given in ([(i, t, None) for i, t, _ in rows], [(i, t, "en") for i, t, _ in rows], [(i, "one and the same", x) for i, _, x in rows]):
        df = spark.createDataFrame(given, plain)
        for floor in (0.0, 1.0):
            got = mixing.mix(df, df, targets, floor=floor).collect()
            assert {(x["rate"], x["copies"]) for x in got} == {(1.0, 1)} and len({x["off"] for x in got}) == 1
            assert Counter(x["doc_id"] for x in mixing.mixed(df, df, targets, floor=floor).collect()) == Counter(range(120))
    known = spark.createDataFrame([(i, f"{t} {x} {x}", x) for i, t, x in rows], plain)
    got = mixing.mix(known, known, {**targets, "es": 0.5}).collect()  # nothing is known of es: it is left out
    assert got[0]["off"] < 0.01 and {x["domain"] for x in got} <= {"en", "de", "es"}


def test_near_duplicates_with_clashing_columns(docs):
    from pyspark.sql import functions as F

    want = sorted(map(repr, (tuple(r) for r in jaccard.one_of_each(docs).collect())))
    odd = docs
    for c in ("_k", "_S", "_key", "class", "_set_key", "set_key", "k", "n", "gone"):
        odd = odd.withColumn(c, F.lit(c))
    out = jaccard.one_of_each(odd)
    assert out.columns == odd.columns
    assert sorted(map(repr, (tuple(r) for r in out.select(*docs.columns).collect()))) == want


def test_mixing_clashing_columns_and_samples(docs, spark):
    from pyspark.sql import functions as F

    odd = docs.withColumn("_rate", F.lit(5)).withColumn("_COPY", F.lit(6)).withColumn("_half", F.lit("h"))
    out = mixing.mixed(odd, odd, {"en": 0.5, "de": 0.5})
    assert out.columns == odd.columns and {tuple(r) for r in out.select("_rate", "_COPY", "_half").collect()} == {(5, 6, "h")}
    # a rare domain is learned from too, and posteriors are told apart as far as labels are found again
    r = random.Random(3)
    rows = [(i, " ".join(f"{lang}{r.randrange(30)}" for _ in range(20)), lang) for i in range(3000) for lang in ["de" if i % 100 == 0 else "en"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = mixing.learn(df, ["de", "en"], sample=200)
    assert (model.sharpness > 5).all()
    found = {x["doc_id"]: x["p"] for x in mixing.posteriors(df, model).collect()}
    assert sum((found[i][0] > 0.5) == (lang == "de") for i, _, lang in rows) > 2980


def test_toxicity(docs, empty, spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = words(r, 40).split()
        if bad:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(["blockhead", "numbskull", "dimwit"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(df, given)
    got = toxicity.score(df, model).collect()
    held = [x for x in got if x["held_out"]]
    assert sum(x["predicted"] == dict(labels)[x["doc_id"]] for x in held) / len(held) > 0.97
    for shown, meant in (("bl0ckh3ad", "blockhead"), ("numbskuuuull", "numbskull"), ("d.i.m.w.i.t", "dimwit")):
        assert model.channel.restore(shown) == meant
    assert model.channel.words("you d i m w i t now") == ["you", "dimwit", "now"]
    assert {x["held_out"] for x in got} == {True, False}
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got)
    assert toxicity.score(docs, model).count() == len(ROWS)
    none = toxicity.learn(docs, given.limit(0))
    assert {x["score"] for x in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0
    # a sample of the labelled rows; null labels and other texts of an id change nothing
    odd = given.union(spark.createDataFrame([(5, None), (None, 1), (7, 0)], "doc_id long, toxic int"))
    repeated = df.union(spark.createDataFrame([(i, "zz " + t) for i, t in rows[:30]], "doc_id long, text string"))
    few, again = toxicity.learn(repeated, odd, sample=250), toxicity.learn(repeated.orderBy("text"), odd, sample=250)
    assert few.odds == again.odds and few.weights.tolist() == again.weights.tolist()
    found = [x for x in toxicity.score(df, few).collect() if x["held_out"]]
    assert sum(x["predicted"] == dict(labels)[x["doc_id"]] for x in found) / len(found) > 0.9


PAGE = '<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home page</a></li><li><a href="/y">About us</a></li></ul></nav><div class="ad">Buy things now</div><article><h1>A title here</h1><p><b>First words &amp; more<br><p>Second  paragraph\nof &eacute;t&eacute; text that goes on for some words.</p></article><div class="comments"><p>Nice one</p></div><footer>&copy; someone</footer></body></html>'


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", PAGE[:-60]), (1, "u", PAGE)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit(1))).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6
    assert text[1] == text[5] == "A title here\n\nFirst words & more\n\nSecond paragraph of été text that goes on for some words."
    assert text[2] == text[3] == text[4] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_raw_and_silent_elements():
    texts = lambda page: [x[0] for x in html.leaves(page)]
    assert texts('<article><h1>Title</h1><p>first para</p><svg class="i"/><p>second para</p><svg><title>t</title><text>no</text></svg><p>third</p></article>') == ["Title", "first para", "second para", "third"]
    assert texts("<div><form><select><option>a<option>b</form><p>after</p><template><p>no</p></div><p>end</p>") == ["after", "end"]
    assert texts("<p>&am<b>p;</b> &amp; &#233;<br>x</p><script>var a = '<p>no</p>'</script><p>y") == ["&amp; & \u00e9 x", "y"]


def test_html_long_and_deep_pages(spark):
    """100,000 leaves in one page; a footer whose text stands in many unnamed wrappers."""
    long = "<html><body><article>" + "".join(f"<p>{'word ' * 20}number {i}.</p>" for i in range(100_000)) + "</article></body></html>"
    wraps = "<div>" * 9
    body = "".join(f"<p>{words(random.Random(i), 40)}.</p>" for i in range(6))
    deep = f"<html><body><nav>{wraps}<a href='/'>Home</a>{'</div>' * 9}</nav><article><h1>A title</h1>{body}</article><footer>{wraps}<p>All rights reserved. Contact, privacy and terms of use.</p>{'</div>' * 9}</footer></body></html>"
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([(1, "u", long), (2, "u", deep)], "page_id long, url string, html string")).collect()}
    assert got[1].count("\n\n") >= 99_990
    assert "rights" not in got[2] and "Home" not in got[2] and got[2].count("\n\n") == 6


def test_html_held_out():
    from tetrad.llm.html_training import accuracy

    leaves, pages = accuracy(html.trained(), pages=300, seed=123)
    assert leaves > 0.99 and pages > 0.93
