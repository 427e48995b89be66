"""The encoder gives exactly the library's ids."""

import random

import numpy as np
import pytest

from tetrad.llm.tokens import Encoder

ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "Hello, world. It's fine", "x.y,z", "...", "a.. b", "., ,.", "don't. 'll we've",
    "3.14, 2,000 ²", "é è ÜBER Straße ñ", "ΑΣ ΟΔΟΣ. Σ", "İstanbul, K Å", "été café.", "á. ́b", "日本語 テキスト。 한국어", "<|endoftext|> x <|startoftext|>",
    "tab\there", "nbsp x", "zero​width", "line sep", "nul\0x", "_._ a_.b", "😀 .😀 a😀.", "MiXeD CaSe wOrDs", "a" * 5000, "ß.ẞ,ŉ",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    e = Encoder(name)
    r = random.Random(3)
    parts = ["an", "É", "ß", ".", ",", " ", " ", "\n", "'s", "12", "!!", "_", "x", "Σ", "́", "\t", "\r\n", "'", "(", "-", "|", "<|endoftext|>", "\x1c", "\u3000", "a-very-long-word" * 2]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    for batch in (texts, texts):  # the second time from memory
        got = e(batch)
        for text, ids in zip(batch, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids, repr(text)
