"""Token alignment against a plain merge with the libraries themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tetrad.llm import align
from tetrad.llm.shared import text_bytes
from tetrad.llm.tokens import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
PARTS = ["an", "É", "ß", ".", ",", " ", " ", "\n", "'s", "12", "!!", "_", "x", "Σ", "́", "\t", "\r\n", ";\r", "(", "-", "|", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\x1c", "\x00", "　", "▁", "😀", "日本", "a-very-long-word" * 2, "therefore", " the", "  "]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path(A))
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


def spelled(one, other):
    """Bytes of an id on each side."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    back = {chr(b) if b in plain else chr(256 + rest.index(b)): b for b in range(256)}
    return (
        lambda i: bytes(back[c] for c in one.id_to_token(i)),
        lambda i: bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("▁", " ").encode(),
    )


def plain(rows):
    one, other = libraries()
    bytes_a, bytes_b = spelled(one, other)
    found = []
    for _, text in rows:
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)) if text else ([], [])
        x, y = [bytes_a(i) for i in a], [bytes_b(i) for i in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            found.append(([], [], [], []))
            continue
        links, groups, i, j, end_a, end_b = [], [([a[0]], [b[0]])], 0, 0, len(x[0]), len(y[0])
        while True:
            links.append((a[i], b[j]))
            left, right = end_a <= end_b, end_b <= end_a
            i, j = i + left, j + right
            if i == len(a):
                break
            if left and right:
                groups.append(([], []))
            if left:
                groups[-1][0].append(a[i])
                end_a += len(x[i])
            if right:
                groups[-1][1].append(b[j])
                end_b += len(y[j])
        found.append((a, b, groups, links))
    count = Counter(p for *_, links in found for p in set(links))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (key, _), (a, b, groups, links) in zip(rows, found, strict=True):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((key, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out, key=repr)


def made():
    r = random.Random(5)
    texts = ["".join(r.choice([p for p in PARTS if i % 9 == 0 or p != "▁"]) for _ in range(r.randint(0, 30))) for i in range(600)]
    return [*enumerate(texts), (None, "x y"), (None, None), (5, "twice"), (5, "twice"), (700, "long words and longer ones " * 30_000), (701, None), (702, ""), (703, " "), (704, "▁")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, block long, place int, pair string").repartition(3)


def test_alignment(spark, monkeypatch):
    rows = made()
    want = plain(rows)
    for links in (500, align.LINKS):  # many blocks, and few
        monkeypatch.setattr(align, "LINKS", links)
        assert sorted(map(tuple, align.align(frame(spark, rows), A, B).collect()), key=repr) == want
    assert align.align(frame(spark, []), A, B).count() == 0
    assert [tuple(x) for x in align.align(frame(spark, [(1, None), (2, "")]), A, B).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_tokenizers_may_change_places(spark):
    rows = [x for x in made() if x[0] is not None and x[0] < 200]
    there, back = ({r["doc_id"]: r for r in align.align(frame(spark, rows), *two).collect()} for two in ((A, B), (B, A)))
    assert all((there[i]["n_a"], there[i]["n_b"], there[i]["n_groups"], there[i]["n_links"]) == (back[i]["n_b"], back[i]["n_a"], back[i]["n_groups"], back[i]["n_links"]) for i in there)


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_are_the_librarys(seed):
    r = random.Random(seed)
    encoder, (_, other) = align.PieceEncoder(B), libraries()
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    data, offsets = text_bytes(pa.array([f" {t}" for t in texts], pa.large_string()))
    for _ in range(2):  # the second time from memory
        ids, bounds = encoder.encode(data, offsets)
        for i, t in enumerate(texts):
            want = other.encode(t) or other.encode("\n")[:1]
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want, repr(t)
    assert np.diff(bounds).min() > 0


def test_pieces_of_nul_and_of_written_blanks():
    """Chunks of NULs, chunks that differ by NULs only, and U+2581 within a run of blanks."""
    encoder, (_, other) = align.PieceEncoder(B), libraries()
    texts = ["a\n\x00", "x", "x\x00", "x\x00\x00", "\n\x00\n\x00\x00\n", "b \x00", "b ", "ß▁  ", "▁ ▁ x", " ▁"]
    data, offsets = text_bytes(pa.array([f" {t}" for t in texts], pa.large_string()))
    for _ in range(2):
        ids, bounds = encoder.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [other.encode(t) for t in texts]


def test_documents_with_nul_have_tokens(spark):
    got = align.align(spark.createDataFrame([(1, "a\n\x00"), (2, "plain")], "doc_id long, text string"), A, B).collect()
    assert {r["doc_id"]: r["n_b"] for r in got} == {1: 3, 2: 1}
