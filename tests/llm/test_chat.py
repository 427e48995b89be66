"""Chat formatting: nothing is lost, nothing inside a text is taken for a mark."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tetrad.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, at long, n int, content string, conv string"
ODD = ["</s>", "<s>", "[INST]", "[/INST]", "<|turn|>", "<|body|>", "<|image|>", "<", "/s>", "\\", "<\\/s>", "[\\\\INST]", "|turn|>", "<|", "a", "é", "😀", "\n", " "]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(rows):
    """What a conversation says, from its rows."""
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role or "", text or ""))
    escaper, t, out = chat.Escaper(chat.Template()), chat.Template(), []
    for conv, turns in of.items():
        turns.sort(key=lambda x: (*x[:3], f"{t.turn}{escaper.escape(x[2])}{t.body}{escaper.escape(x[3])}"))
        learned = "".join(x for *_, role, x in turns if role == "assistant")
        n = sum(len(t.turn + t.body + t.end) + len(escaper.escape(role)) + len(escaper.escape(x)) for *_, role, x in turns)
        out.append((conv, len(turns), digest("".join(f"{role}\n{x}\n" for *_, role, x in turns)), len(learned), digest(learned), n, 0, 0))
    return sorted(out, key=repr)


def test_escaping_is_undone():
    r = random.Random(3)
    escaper = chat.Escaper(chat.Template())
    for _ in range(20_000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 8)))
        told = escaper.escape(text)
        assert not any(c in told for c in escaper.template.controls)
        assert escaper.unescape(told) == text
        other = "".join(r.choice(ODD) for _ in range(r.randint(0, 4)))
        t = escaper.template
        whole = f"{t.turn}{escaper.escape(other)}{t.body}{told}{t.end}{t.turn}{told}{t.body}{escaper.escape(other)}{t.end}"
        assert list(escaper.turns(whole)) == [(other, text), (text, other)]


def test_templates_that_cannot_be_told_apart():
    for bad in ({"end": "<"}, {"end": "/s<"}, {"escape": "<"}, {"escape": "\\\\"}, {"end": "<|turn|>"}, {"image": "<|turn|>s"}, {"reserved": ("a\\b",)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)
    other = chat.Escaper(chat.Template(turn="«turn»", body="«body»", end="«end»", image="«i»", audio="«a»", document="«d»", reserved=(), escape="~"))
    assert other.unescape(other.escape("«end» «~end» </s>")) == "«end» «~end» </s>" and "</s>" in other.escape("</s>")


def test_conversations(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", "<|body|>", None, ""]), "".join(r.choice(ODD) for _ in range(r.randint(0, 12)))) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", "x" * (t % 3)) for t in range(1500)]  # over several batches
    rows += [(None, 0, "user", "lost"), (None, None, "assistant", None), (60, None, None, None), (61, 2, "user", "b"), (61, 2, "user", "a"), (61, 2, "user", "a"), (62, 0, "assistant", "long " * 50_000), (-7, 0, "user", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*x, 9, 1, "x", "y") for x in rows], SCHEMA).repartition(5)
    formatted = chat.format_turns(df).persist()
    got = sorted(map(tuple, chat.read_back(formatted).collect()), key=repr)
    assert got == plain(rows)
    turns = formatted.where("conv_id = 61").orderBy("turn_no").collect()
    assert "".join(x["formatted"] for x in turns) == "".join(f"<|turn|>user<|body|>{x}</s>" for x in "aab") and [x["at"] for x in turns] == [0, 25, 50]
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_typed_parts(spark):
    part = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
    said = [
        [("text", "see <", None, None, None, None, None), ("text", "/s> ", None, None, None, None, None), ("image", None, "a.png", 100, 50, None, None), None, ("text", " and ", None, None, None, None, None), ("audio", None, "b.wav", None, None, 2.0, None)],
        [("document", None, "c.pdf", None, None, None, 3), ("text", "read", None, None, None, None, None), ("image", None, None, None, None, None, None)],
        [("video", "only text", None, None, None, None, None), ("video", None, "d.mp4", None, None, None, None), (None, "!", None, None, None, None, None)],
        [],
        None,
    ]
    rows = [(1, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(said)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text array<{part}>").repartition(2)
    costs = chat.Costs(patch=28, second=10.0, page=500, image=256)
    made = chat.format_turns(df, costs=costs, learned=("assistant",)).orderBy("turn_no").collect()
    whole = "".join(x["formatted"] for x in made)
    assert list(chat.Escaper(chat.Template()).turns(whole)) == [("user", "see </s>  and "), ("assistant", "read"), ("user", "only text!"), ("assistant", ""), ("user", "")]
    held = [tuple(a) for x in made for a in x["attachments"]]
    assert [(k, ref, n) for _, k, ref, n in held] == [("image", "a.png", 4 * 2), ("audio", "b.wav", 20), ("document", "c.pdf", 1500), ("image", None, 256), ("document", "d.mp4", 500)]
    assert [whole[at:].startswith(f"<|{kind}|>") for at, kind, *_ in held] == [True] * 5
    assert ["".join(whole[s["start"] : s["start"] + s["length"]] for s in x["loss"]) for x in made] == ["", "read", "", "", ""]
    back = chat.read_back(chat.format_turns(df, costs=costs)).first()
    assert (back["n_turns"], back["loss_chars"], back["n_attachments"], back["expanded_tokens"]) == (5, 4, 5, 8 + 20 + 1500 + 256 + 500)
    plain_text = chat.format_turns(df.select("conv_id", "turn", "role", F.lit("see").alias("text")))
    assert {len(x["attachments"]) for x in plain_text.collect()} == {0}
