"""Trains the block labeller on generated pages: ``python -m tetrad.llm.html_training``.

The generator knows what it writes, so each leaf's label is given: main text is
what stands in the article proper.  Words are random syllables, with words of
interface texts mixed into the rest of the page, so that the labeller leans on
the structure of the page and not on a language.
"""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np

from tetrad.llm.html import HIDDEN, WIDTH, leaves, lstm, padded, sigmoid, vectors

_SYLLABLES = "an ba ch de er fo ga he in ja ko la me nt on pe qu re st th ur ve wi xa yo za é ö ñ ss tion ing ment keit".split()
_INTERFACE = "home about contact login subscribe cookie privacy terms share follow comment reply search menu sign up accept newsletter advertisement sponsored related posts read more copyright rights reserved".split()


class Page:
    """Writes a page; main text is marked by a character that the labels look for."""

    MARK = "⁣"

    def __init__(self, r: random.Random) -> None:
        self.r = r

    def odd(self) -> str:
        """Main text that is not prose: a word or phrase again and again, capitals, symbols."""
        r = self.r
        words = self.words(1, r.choice([1, 3, 30])).split()
        kind = r.random()
        if kind < 0.6:
            words = words * r.randint(2, 60)
        elif kind < 0.75:
            words = [w.upper() + "!!" for w in words] * r.randint(1, 4)
        elif kind < 0.9:
            words = [w + r.choice(["###", "***", "$$$", "%%%"]) for w in words] * r.randint(1, 4)
        else:
            words = " | ".join(words * r.randint(1, 6)).split()
        return " ".join(words)

    def words(self, low: int, high: int, interface: float = 0.0) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            if r.random() < interface:
                out.append(r.choice(_INTERFACE))
            else:
                w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
                out.append(w + ("," if r.random() < 0.06 else ". " if r.random() < 0.1 else ""))
        text = " ".join(out)
        return text[:1].upper() + text[1:] if r.random() < 0.9 else text

    def name(self, *choices: str, often: float = 0.9) -> str:
        if self.r.random() > often:
            return ""
        kind = self.r.choice(["class", "class", "id"])
        extra = self.r.choice(["", "", "", " box", " clearfix", " col-2", " wrapper"])
        return f' {kind}="{self.r.choice(choices)}{extra}"'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3, 0.5)}</a>' for i in range(self.r.randint(low, high))]
        if self.r.random() < 0.8:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " ".join(items)

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div{self.name('logo', 'brand')}>{self.words(1, 3)}</div>", f"<p>{self.words(2, 7)}</p>"])
        nav = self.nav() if self.r.random() < 0.5 else ""
        return self.r.choice([f"<header>{inner}{nav}</header>", f"<div{self.name('header', 'top', 'masthead', 'site-header', often=1)}>{inner}{nav}</div>"])

    def nav(self) -> str:
        return self.r.choice([f"<nav>{self.links(2, 9)}</nav>", f"<nav{self.name('menu', 'main-nav')}>{self.links(2, 9)}</nav>", f"<div{self.name('nav', 'menu', 'navigation', 'breadcrumbs', 'navbar', often=1)}>{self.links(2, 7)}</div>", f'<ul{self.name("menu", "nav", "breadcrumb", often=1)}><li><a href="/">{self.words(1, 2)}</a></li><li>{self.words(1, 2)}</li></ul>'])

    def ad(self) -> str:
        text = self.words(3, 30, 0.1)
        inner = self.r.choice([text, f"<p>{text}</p>", f'<a href="/x">{text}</a>', f"<b>{text}</b>"])
        tag = self.r.choice(["div", "div", "aside", "section", "ins", "p"])
        return f"<{tag}{self.name('ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsor', 'sponsored', 'promo', 'ad-slot', 'adbox', often=1)}>{inner}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(["div", "section", "p", "aside"])
        text = self.words(5, 40, 0.3)
        more = f"<button>{self.words(1, 2, 0.8)}</button>" if self.r.random() < 0.5 and tag != "p" else ""
        inner = text if tag == "p" or self.r.random() < 0.4 else f"<p>{text}</p>"
        return f"<{tag}{self.name('notice', 'cookie-notice', 'cookie-banner', 'cookies', 'alert', 'consent', 'gdpr', 'banner notice', 'paywall', 'message', often=1)}>{inner}{more}</{tag}>"

    def sidebar(self) -> str:
        parts = [f"<h3>{self.words(1, 4, 0.4)}</h3>"] * (self.r.random() < 0.7)
        parts += [self.r.choice([self.links(2, 8), f"<p>{self.words(5, 45)}</p>", f"<p>{self.words(5, 20)}</p><p>{self.words(5, 30)}</p>", self.ad()]) for _ in range(self.r.randint(1, 3))]
        inner = "".join(parts)
        return self.r.choice([f"<aside>{inner}</aside>", f"<aside{self.name('sidebar', 'related')}>{inner}</aside>", f"<div{self.name('sidebar', 'side', 'related', 'widget', 'rail', 'recommended', 'more-stories', often=1)}>{inner}</div>"])

    def form(self) -> str:
        kind = self.r.choice(["form", "form", "form", "fieldset"])
        inner = self.r.choice([f"<label>{self.words(1, 3, 0.7)}</label><input name=q><button>{self.words(1, 2, 0.9)}</button>", f"<p>{self.words(3, 20, 0.3)}</p><input type=email><button>{self.words(1, 2, 0.9)}</button>", f"<h3>{self.words(1, 5)}</h3><select><option>x</option></select><input type=submit>", f"{self.words(2, 15, 0.3)}<input>"])
        return f"<{kind}{self.name('search', 'newsletter', 'login', 'signup', 'subscribe', often=0.6)}>{inner}</{kind}>"

    def comments(self) -> str:
        one = lambda: self.r.choice([f"<div{self.name('comment', 'reply', often=0.9)}><p>{self.words(3, 60)}</p></div>", f"<li{self.name('comment', often=0.8)}><b>{self.words(1, 2)}</b><p>{self.words(3, 60)}</p></li>", f"<p>{self.words(3, 50)}</p>", f"<article{self.name('comment', often=1)}><p>{self.words(3, 50)}</p></article>"])
        head = f"<h2>{self.words(1, 3, 0.5)}</h2>" * (self.r.random() < 0.6)
        inner = head + "".join(one() for _ in range(self.r.randint(1, 6)))
        tag = self.r.choice(["div", "section", "ol", "ul"])
        return f"<{tag}{self.name('comments', 'comment-list', 'discussion', 'responses', 'reader-comments', often=1)}>{inner}</{tag}>"

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.words(2, 25, 0.1)}", f"<p>&copy; {self.words(2, 12, 0.3)}</p>{self.links(1, 5)}", f"<p>{self.words(3, 25)}</p>", self.links(2, 6)])
        return self.r.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{self.name('footer', 'site-footer', 'bottom', 'copyright', often=1)}>{inner}</div>"])

    def article(self) -> str:
        r, mark = self.r, self.MARK
        w = lambda low, high: mark + (self.odd() if r.random() < 0.07 else self.words(low, high * r.choice([1, 1, 1, 1, 8])))
        parts = [f"<h1>{w(1, 14)}</h1>"] * (r.random() < 0.85)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 10, 20])):
            kind = r.random()
            if kind < 0.72:
                parts.append(f"<p>{w(1, 90)}{'</p>' if r.random() < 0.85 else ''}")
            elif kind < 0.80:
                parts.append(f"<p><b>{w(1, 40)}<br>")
            elif kind < 0.85:
                parts.append(f"<h{r.randint(2, 4)}>{w(1, 8)}</h{r.randint(2, 4)}>")
            elif kind < 0.89:
                parts.append("<ul>" + "".join(f"<li>{w(1, 15)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{r.choice(['', '<p>'])}{w(3, 40)}</blockquote>")
            elif kind < 0.94:
                parts.append(f"<pre>{w(2, 20)}</pre>")
            elif kind < 0.96:
                parts.append("<table><tr>" + "".join(f"<td>{w(1, 4)}</td>" for _ in range(r.randint(1, 4))) + "</tr></table>")
            elif kind < 0.98:
                parts.append(f"<p>{w(1, 20)} <a href='/l'>{self.words(1, 4)}</a> {self.words(1, 20)}</p>")
            else:
                parts.append(f"<figure><img src=x><figcaption>{w(2, 12)}</figcaption></figure>")
            if r.random() < 0.06:
                parts.append(r.choice([self.ad, self.ad, self.sidebar, self.form, self.notice, self.nav])())
        if r.random() < 0.08:
            parts.append(self.comments())
        inner = "".join(parts)
        form = r.random()
        if form < 0.6:
            return f"<article>{inner}</article>"
        if form < 0.7:
            return f"<article{self.name('post', 'article', 'entry', 'story')}>{inner}</article>"
        if form < 0.78:
            return f"<main>{inner}</main>"
        if form < 0.88:
            return f"<main><article>{inner}</article>{self.comments() if r.random() < 0.3 else ''}</main>"
        return f"<div{self.name('content', 'post', 'article-body', 'entry-content', 'main', 'story', often=1)}>{inner}</div>"

    def nested(self, body: str) -> str:
        """The page with unnamed wrappers around its paragraphs, within its items, and icons."""
        r, deep = self.r, self.r.randint(1, 14)

        def wrapped(m: re.Match) -> str:
            n = r.randint(deep // 2, deep)
            icon = r.choice(['<svg class="i"/>', '<svg viewBox="0 0 1 1"><path d="M0 0"/></svg>']) * (r.random() < 0.1)
            if m[1] in ("li", "td", "dd"):
                return f"<{m[1]}{m[2]}>{'<div>' * n}{icon}{m[3]}{'</div>' * n}</{m[1]}>"
            return f"{'<div>' * n}<{m[1]}{m[2]}>{icon}{m[3]}</{m[1]}>{'</div>' * n}"

        return re.sub(r"<(p|li|h[1-6]|td|dd)\b([^>]*)>((?:(?!<(?:p|li|h[1-6]|td|dd|ul|ol|div|table)\b).)*?)</\1>", wrapped, body, flags=re.S)

    def page(self) -> str:
        r = self.r
        before = [f() for f in (self.header, self.nav, self.notice, self.ad, self.form, self.sidebar) for _ in range(r.random() < (0.75 if f == self.nav else 0.4))]
        after = [f() for f in (self.ad, self.sidebar, self.form, self.comments, self.notice, self.nav) for _ in range(r.random() < 0.35)]
        r.shuffle(before)
        r.shuffle(after)
        body = "".join([*before, "<!-- ad 3 -->" * (r.random() < 0.5), self.article(), *after, self.footer() * (r.random() < 0.9)])
        if r.random() < 0.2:
            body = f"<div{self.name('page', 'wrap', 'container', 'layout')}>{body}</div>"
        head = f"<head><title>{self.words(2, 12)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        if r.random() < 0.3:
            body = self.nested(body)
        html = f"<!DOCTYPE html><html>{head * (r.random() < 0.95)}<body>{body}</body></html>"
        return html[: r.randint(len(html) * 9 // 10, len(html))] if r.random() < 0.1 else html


def generated(n: int, seed: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Vectors, leaves a page, and labels of n pages."""
    r = random.Random(seed)
    pages, labels = [], []
    while len(pages) < n:
        found = leaves(Page(r).page())
        if found:
            labels += [Page.MARK in x[0] for x in found]
            pages.append([(x[0].replace(Page.MARK, ""), *x[1:]) for x in found])
    return vectors(pages), [len(p) for p in pages], np.array(labels, np.float32)


def gradients(x: np.ndarray, kept: list, w: np.ndarray, u: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of w, u and b, for the gradient of the states."""
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN)
    dh = dc = np.zeros(upper.shape[1:])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, a, before, c, last = kept[t]
        dh = dh + upper[t]
        tc = np.tanh(c)
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * a * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
        dw += x[t].T @ dg
        du += last.T @ dg
        db += dg.sum(0)
        dh, dc = dg @ u.T, dc * f
    return dw, du, db


def train(pages: int = 20000, epochs: int = 12, batch: int = 40, rate: float = 0.004, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the cross entropy of all leaves."""
    rng = np.random.default_rng(seed)
    rows, counts, labels = generated(pages, seed)
    firsts = np.concatenate([[0], np.cumsum(counts)]).astype(int)
    shapes = {"w": (WIDTH, 4 * HIDDEN), "u": (HIDDEN, 4 * HIDDEN), "b": (4 * HIDDEN,), "v": (HIDDEN,)}
    weights = {f"{k}{d}": rng.normal(0, 0.12, s) if k != "b" else np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN) for d in (0, 1) for k, s in shapes.items()} | {"c": np.zeros(1)}
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for epoch in range(epochs):
        order, total = rng.permutation(pages), 0.0
        for at in range(0, pages, batch):
            group = order[at : at + batch]
            own = [counts[p] for p in group]
            x = np.concatenate([rows[firsts[p] : firsts[p + 1]] for p in group]).astype(np.float64)
            y = np.concatenate([labels[firsts[p] : firsts[p + 1]] for p in group])[:, None].astype(np.float64)
            ahead, back = padded(x, own)
            goal, _ = padded(y, own)
            there, _ = padded(np.ones_like(y), own)
            states, kept = zip(*[lstm(z, weights[f"w{d}"], weights[f"u{d}"], weights[f"b{d}"]) for d, z in enumerate((ahead, back))], strict=True)

            def flip(z: np.ndarray, own: list[int] = own) -> np.ndarray:
                out = np.zeros_like(z)
                for k, n in enumerate(own):
                    out[:n, k] = z[:n, k][::-1]
                return out

            logit = states[0] @ weights["v0"] + flip(states[1] @ weights["v1"]) + weights["c"][0]
            p = sigmoid(logit)
            error = (p - goal[:, :, 0]) * there[:, :, 0] / len(y)
            total += -np.log(np.where(goal[:, :, 0] > 0, p, 1 - p)[there[:, :, 0] > 0] + 1e-9).mean()
            grads = {"c": np.array([error.sum()])}
            for d, (z, e) in enumerate(((ahead, error), (back, flip(error)))):
                grads[f"v{d}"] = np.einsum("tp,tph->h", e, states[d])
                grads[f"w{d}"], grads[f"u{d}"], grads[f"b{d}"] = gradients(z, kept[d], weights[f"w{d}"], weights[f"u{d}"], e[:, :, None] * weights[f"v{d}"])
            step += 1
            lr = rate * (1 - 0.9 * step / (epochs * (-(-pages // batch))))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {total / (pages / batch):.4f}", flush=True)
    return weights


def accuracy(weights: dict[str, np.ndarray], pages: int = 1000, seed: int = 99) -> tuple[float, float]:
    """Shares of leaves and of whole pages that are labelled right, on other pages."""
    from tetrad.llm.html import scores

    rows, counts, labels = generated(pages, seed)
    right = (scores(weights, rows, counts) >= 0.5) == (labels > 0)
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(int)
    return float(right.mean()), float(np.minimum.reduceat(right, firsts).mean())


if __name__ == "__main__":
    made = {k: v.astype(np.float32) for k, v in train().items()}
    print("held out: leaves %.4f, pages %.4f" % accuracy(made))
    np.savez_compressed(Path(__file__).with_name("html_weights.npz"), **{k: v.astype(np.float16) for k, v in made.items()})
