"""HTML extraction: a recurrent labeller of text blocks.

A page is cut into leaves: runs of text between block-level tags, in page
order, each with its path of open tags and their classes.  A bidirectional LSTM
in numpy reads the leaves' vectors (hashed tag path, hashed classes, hashed
words, shape of the text) and labels every leaf as main text or not, with the
whole page as context.  Its weights are trained by ``html_training`` on pages
that are generated there; no test table is used.

Text in ``RAW`` and ``SILENT`` elements and comments is markup and never a leaf.
Character references are decoded within a run of text, never across a tag.

Defined results: null and empty pages, and pages without a main leaf, give an
empty text; unclosed tags end with their parent, and an unfinished tag at the
end is dropped; pages of any length are read whole; repeated rows give one
result each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.llm import kernels as K
from tetrad.llm.shared import small_batches

#: Elements whose content is read as raw text up to their end tag, as in the HTML standard; it is no text of the page.
RAW = ("script", "style", "noscript", "textarea", "iframe", "title")
#: Elements with tags of their own whose text is none of the page; unclosed ones end with their parent.
SILENT = frozenset(("template", "select", "svg"))
#: Tags that do not end a leaf.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block tags that end an open paragraph, as in the HTML standard.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements beyond which an unclosed paragraph or item is not looked for.
SCOPE = frozenset("html body table td th article section div nav aside main footer header form ul ol button".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>|\Z)|<[!?][^>]*(?:>|\Z)|<|[^<]+",
    re.S | re.I,
)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")

PATH, NAMES, WORDS, SHAPE = 48, 48, 24, 8
WIDTH = PATH + NAMES + WORDS + SHAPE
HIDDEN = 20


@cache
def _slot(word: str, size: int) -> tuple[int, float]:
    """Place and sign of a hashed word."""
    h = 0
    for b in word.encode():
        h = (h * 1000003 + b + 1) & 0xFFFFFFFF
    h ^= h >> 15
    return h % size, 1.0 if h >> 20 & 1 else -1.0


class Leaf:
    __slots__ = ("link", "path", "names", "raw")

    def __init__(self, path: tuple[str, ...], names: tuple[str, ...]) -> None:
        self.path, self.names, self.raw, self.link = path, names, [], 0

    def text(self) -> str:
        return " ".join("".join(self.raw).split())


def leaves(html: str) -> list[tuple[str, tuple[str, ...], tuple[str, ...], float]]:
    """(text, tag path, class and id words, share of the text in links) per leaf."""
    stack: list[str] = []
    names: list[tuple[str, ...]] = []
    out: list[Leaf] = []
    now: Leaf | None = None
    linked = silent = 0

    def drop(at: int) -> None:
        del stack[at:], names[at:]

    for m in _TOKEN.finditer(html):
        tag = m["tag"]
        if tag is None:
            part = m[0]
            if m["raw"] or part[:2] in ("<!", "<?") or silent:
                continue
            if now is None:
                if part.isspace():
                    continue
                now = Leaf(tuple(stack), tuple(n for s in names for n in s))
                out.append(now)
            now.raw.append(unescape(part))
            if linked:
                now.link += len(now.raw[-1])
            continue
        if not m["close"]:
            break  # the page ends inside a tag
        tag = tag.lower()
        if tag == "br":
            if now is not None:
                now.raw.append(" ")
            continue
        if tag not in INLINE:
            now = None
        if m["end"]:
            if tag in stack:
                at = len(stack) - 1 - stack[::-1].index(tag)
                drop(at)
                linked, silent = stack.count("a"), sum(x in SILENT for x in stack)
            continue
        ended = ENDS.get(tag) or ({"p"} if tag in ENDS_P else None)
        if ended:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at] in ended:
                    drop(at)
                    break
                if stack[at] in SCOPE:
                    break
            linked, silent = stack.count("a"), sum(x in SILENT for x in stack)
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        stack.append(tag)
        linked += tag == "a"
        silent += tag in SILENT
        found = _NAME.findall(m["attrs"]) if "=" in m["attrs"] else ()
        names.append(tuple(w for x in found for w in _PART.findall((x[0] or x[1] or x[2]).lower()) if not w.isdigit()))
    made = ((x.text(), x.path, x.names, x.link / max(1, sum(map(len, x.raw)))) for x in out)
    return [x for x in made if x[0]]


def vectors(pages: list[list[tuple[str, tuple[str, ...], tuple[str, ...], float]]]) -> np.ndarray:
    """One row for each leaf of all pages."""
    flat = [x for page in pages for x in page]
    out = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return out
    coded = [x[0].encode() for x in flat]
    data = np.frombuffer(b"".join(coded), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64)
    starts, ends = K.spans(~K.WHITE[data], offsets)
    owner, hashed = K.owners(starts, offsets), K.hashes(K.LOWER[data], starts, ends)
    place = owner * WORDS + (hashed % np.uint64(WORDS)).astype(np.int64)
    sign = np.where(hashed >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    n_words = np.bincount(owner, minlength=len(flat))
    words = np.bincount(place, weights=sign, minlength=len(flat) * WORDS).reshape(-1, WORDS)
    out[:, PATH + NAMES : PATH + NAMES + WORDS] = words / (np.linalg.norm(words, axis=1) + 1e-6)[:, None]
    dots = np.bincount(K.owners(np.flatnonzero((data == 46) | (data == 44)), offsets), minlength=len(flat))
    shape = out[:, PATH + NAMES + WORDS :]
    sizes = np.diff(offsets)
    shape[:, 0] = np.minimum(np.log1p(n_words), 6) / 5
    shape[:, 1] = [x[3] for x in flat]
    shape[:, 2] = np.minimum(1, dots / n_words * 4)
    shape[:, 3] = np.minimum(sizes / n_words / 10, 2)
    shape[:, 4] = n_words > 12
    shape[:, 5] = 1
    first = 0
    for page in pages:
        n = len(page)
        shape[first : first + n, 6] = np.arange(n) / max(1, n)
        shape[first : first + n, 7] = 1 / (1 + np.arange(n))
        first += n
    for i, (_, path, names, _) in enumerate(flat):
        row = out[i]
        for depth, tag in enumerate(reversed(path)):
            at, s = _slot(tag, PATH)
            row[at] += s * (1.0 if depth < 2 else 0.7 if depth < 6 else 4.2 / depth)
        for name in names:
            at, s = _slot(name, NAMES)
            row[PATH + at] += s
    # many wrappers of one kind say no more than some
    np.clip(out[:, :PATH], -3, 3, out=out[:, :PATH])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, trace: bool = True) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """States over time of x (time, pages, width), and, with ``trace``, what training needs again."""
    h = c = np.zeros((x.shape[1], HIDDEN), x.dtype)
    gates, states, kept = x @ w + b, np.empty((*x.shape[:2], HIDDEN), x.dtype), []
    for t in range(len(x)):
        g = gates[t] + h @ u
        i, f, o = (sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        a = np.tanh(g[:, 3 * HIDDEN :])
        before, last = c, h
        c = f * c + i * a
        h = o * np.tanh(c)
        states[t] = h
        if trace:
            kept.append((i, f, o, a, before, c, last))
    return states, kept


def padded(rows: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(time, pages, width), zero behind each page's end, and the same with time reversed within each page."""
    most = max(counts)
    ahead = np.zeros((most, len(counts), rows.shape[1]), rows.dtype)
    back = np.zeros_like(ahead)
    first = 0
    for p, n in enumerate(counts):
        ahead[:n, p] = rows[first : first + n]
        back[:n, p] = rows[first : first + n][::-1]
        first += n
    return ahead, back


def scores(weights: dict[str, np.ndarray], rows: np.ndarray, counts: list[int]) -> np.ndarray:
    """Probability of main text for each leaf, pages of like length together."""
    out = np.zeros(len(rows), np.float32)
    firsts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    order = sorted((p for p in range(len(counts)) if counts[p]), key=lambda p: counts[p])
    at = 0
    while at < len(order):
        group = [order[at]]
        while at + len(group) < len(order) and (len(group) + 1) * counts[order[at + len(group)]] <= 16384:
            group.append(order[at + len(group)])
        at += len(group)
        own = [counts[p] for p in group]
        take = np.concatenate([np.arange(firsts[p], firsts[p + 1]) for p in group])
        ahead, back = padded(rows[take], own)
        fore, _ = lstm(ahead, weights["w0"], weights["u0"], weights["b0"], trace=False)
        aft, _ = lstm(back, weights["w1"], weights["u1"], weights["b1"], trace=False)
        logit_f, logit_b = fore @ weights["v0"], aft @ weights["v1"]
        got = np.concatenate([logit_f[:n, k] + logit_b[:n, k][::-1] for k, n in enumerate(own)])
        out[take] = sigmoid(got + weights["c"][0])
    return out


@cache
def trained() -> dict[str, np.ndarray]:
    with np.load(Path(__file__).with_name("html_weights.npz")) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: float = 0.5) -> DataFrame:
    """(key, url, text, n_chars): the main leaves of each page, joined by empty lines."""
    spark = pages.sparkSession
    small_batches(spark)
    source = pages.select(F.col(f"`{key}`"), F.col(f"`{url}`"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            column = batch.column("html")
            held, size = [], 0
            for i in range(len(column)):
                page = column[i].as_py()
                held.append(leaves(page))
                size += len(page)
                if size > 2_000_000 or i == len(column) - 1:
                    counts = [len(p) for p in held]
                    main = scores(weights, vectors(held), counts) >= least
                    first = 0
                    for page, n in zip(held, counts, strict=True):
                        out.append("\n\n".join(x[0] for x, m in zip(page, main[first : first + n], strict=True) if m))
                        first += n
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [key, url, "text", "n_chars"])

    kinds = {c: source.schema[c].dataType.simpleString() for c in (key, url)}
    return source.mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
