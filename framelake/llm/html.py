"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: runs of inline text between block-level tags,
each with its ancestor tags and their class names. Features of ancestors and of
the text feed a chain with two labels (article or not). It is trained by
gradient ascent on the exact likelihood (forward-backward) over labelled pages,
and decoded by Viterbi. The labelled pages come from ``labelled_pages``, which
composes pages of many layouts from a seed.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# Elements of HTML by kind.
RAW = {"script", "style", "template", "iframe", "title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "mi", "mn", "mo", "mrow", "ms", "msqrt", "msub", "msup", "mfrac", "mtext", "svg", "g", "text", "tspan",
}
CLOSED_BY_BLOCK = {"p"}
CLOSED_BY_SAME = {"li", "dt", "dd", "tr", "td", "th", "option"}
KEYWORDS = {
    "ad": {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "adsense"},
    "nav": {"nav", "navigation", "menu", "breadcrumb", "breadcrumbs", "navbar", "toc", "pagination", "pager", "tabs"},
    "foot": {"footer", "foot", "copyright", "legal", "colophon"},
    "head": {"header", "masthead", "topbar", "logo", "branding"},
    "side": {"sidebar", "side", "aside", "widget", "related", "recommended", "trending", "popular", "complementary"},
    "comment": {"comment", "comments", "reply", "replies", "disqus", "discussion", "respond"},
    "notice": {"cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "alert", "newsletter", "subscribe", "paywall"},
    "share": {"share", "social", "sharing", "follow", "tags", "meta", "byline"},
    "form": {"form", "search", "login", "signup", "contact"},
    "content": {"content", "article", "post", "entry", "story", "main", "body", "text", "prose"},
}
CLASS_OF = {word: kind for kind, names in KEYWORDS.items() for word in names}
TAGS = {
    "nav", "header", "footer", "aside", "article", "main", "form", "ul", "ol", "li", "table", "figure", "figcaption", "p", "pre",
    "blockquote", "section", "h1", "h2", "h3", "h4", "h5", "h6", "button", "select", "dl", "body", "dialog", "fieldset", "details",
}


def blocks(html: str | None) -> list[tuple[str, dict[str, float]]]:
    """Leaf blocks in page order: text, and features of ancestors and text."""
    html = html or ""
    out: list[tuple[str, dict[str, float]]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            out.append((text, _features(text, linked, stack)))
        pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            pieces.append(raw)
            if any(t == "a" for t, _ in stack):
                linked += len(raw)

    while at < len(html):
        start = html.find("<", at)
        m = MARKUP.match(html, start) if start >= 0 else None
        while start >= 0 and m is None:  # a lone "<" is text
            start = html.find("<", start + 1)
            m = MARKUP.match(html, start) if start >= 0 else None
        if m is None:
            say(html[at:])
            break
        say(html[at:start])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name in CLOSED_BY_BLOCK or (name == tag and tag in CLOSED_BY_SAME):
                    del stack[k:]
                    break
                if name not in INLINE:
                    break
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append((tag, _classes(m[3])))
    flush()
    for k, (_, f) in enumerate(out):
        f["first"], f["last"] = float(k == 0), float(k == len(out) - 1)
    return out


def _classes(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    kinds = set()
    for m in ATTRIBUTE.finditer(attributes):
        for word in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").lower()):
            if word in CLASS_OF:
                kinds.add(CLASS_OF[word])
    return tuple(sorted(kinds))


def _features(text: str, linked: int, stack: list) -> dict[str, float]:
    f = {"bias": 1.0}
    for tag, kinds in stack:
        if tag in TAGS:
            f["tag:" + tag] = 1.0
        for kind in kinds:
            f["class:" + kind] = 1.0
    words = text.count(" ") + 1
    f["words:" + str(min(6, int(math.log2(words))))] = 1.0
    f["links:" + str(min(3, 3 * linked // max(1, len(text))))] = 1.0
    f["stop"] = float(text[-1] in ".!?:;…\"'”")
    f["comma"] = float("," in text)
    f["mark"] = float("©" in text or "|" in text or "·" in text)
    near = [t for t, _ in stack if t not in INLINE]
    f["own:" + (near[-1] if near and near[-1] in TAGS else "other")] = 1.0
    return f


class Chain:
    """A linear chain with labels 0 (other) and 1 (article)."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weight = np.zeros((0, 2))
        self.move = np.zeros((2, 2))

    def scores(self, feats: list[dict[str, float]]) -> np.ndarray:
        out = np.zeros((len(feats), 2))
        for t, f in enumerate(feats):
            for name, value in f.items():
                if value and (k := self.index.get(name)) is not None:
                    out[t] += value * self.weight[k]
        return out

    def fit(self, pages: list[tuple[list[dict[str, float]], list[int]]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> Chain:
        """Stochastic gradient ascent on the log likelihood, with Adagrad steps."""
        for feats, _ in pages:
            for f in feats:
                for name in f:
                    self.index.setdefault(name, len(self.index))
        self.weight = np.zeros((len(self.index), 2))
        seen_w, seen_m = np.full_like(self.weight, 1e-2), np.full_like(self.move, 1e-2)
        matrices = []
        for feats, labels in pages:
            x = np.zeros((len(feats), len(self.index)))
            for t, f in enumerate(feats):
                for name, value in f.items():
                    x[t, self.index[name]] = value
            matrices.append((x, np.array(labels)))
        order = random.Random(seed)
        for _ in range(epochs):
            order.shuffle(matrices)
            for x, y in matrices:
                if not len(y):
                    continue
                single, pair = self._marginals(x @ self.weight)
                truth = np.eye(2)[y]
                grad = x.T @ (truth - single) - decay * self.weight
                moves = -pair
                np.add.at(moves, (y[:-1], y[1:]), 1.0)
                seen_w += grad**2
                seen_m += moves**2
                self.weight += rate * grad / np.sqrt(seen_w)
                self.move += rate * moves / np.sqrt(seen_m)
        return self

    def _marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(score)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = score[0]
        for t in range(1, n):
            ahead[t] = score[t] + np.logaddexp(ahead[t - 1, 0] + self.move[0], ahead[t - 1, 1] + self.move[1])
        for t in range(n - 2, -1, -1):
            after = score[t + 1] + back[t + 1]
            back[t] = np.logaddexp(self.move[:, 0] + after[0], self.move[:, 1] + after[1])
        total = np.logaddexp(*ahead[-1])
        pair = np.zeros((2, 2))
        if n > 1:
            joint = ahead[:-1, :, None] + self.move[None] + (score[1:] + back[1:])[:, None, :]
            pair = np.exp(joint - total).sum(axis=0)
        return np.exp(ahead + back - total), pair

    def viterbi(self, feats: list[dict[str, float]]) -> list[int]:
        """The likeliest labels; ties go to label 0."""
        score = self.scores(feats).tolist()
        if not score:
            return []
        (a, b), (c, d) = self.move.tolist()
        best0, best1 = score[0]
        came: list[tuple[int, int]] = []
        for s0, s1 in score[1:]:
            from0, from1 = int(best1 + c > best0 + a), int(best1 + d > best0 + b)
            came.append((from0, from1))
            best0, best1 = s0 + max(best0 + a, best1 + c), s1 + max(best0 + b, best1 + d)
        label = int(best1 > best0)
        path = [label]
        for step in reversed(came):
            label = step[label]
            path.append(label)
        return path[::-1]


def labelled_pages(count: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with the label of each leaf block."""
    rng = random.Random(seed)
    syllables = "an be co de el fi ga ho in ja ka lo me ni or pa qui re sa te un vo wa zy th er est ing".split()

    def sentence(low: int, high: int) -> str:
        n = rng.randint(low, high)
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
        for k in range(len(words) - 1):
            if rng.random() < 0.08:
                words[k] += ","
            if rng.random() < 0.05:
                words[k] += rng.choice(["&amp;", "***", "%%%", "&lt;x&gt;", "###", "&#39;", " | "])
        return (" ".join(words)).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        return " ".join(sentence(1, 25) for _ in range(rng.choice([1, 1, 2, 4, 8])))

    pages = []
    for _ in range(count):
        html: list[str] = []
        labels: list[int] = []

        def put(markup: str, label: int) -> None:
            html.append(markup)
            labels.append(label)

        def menu(tag: str, attr: str) -> None:
            html.append(f"<{tag}{attr}><ul>")
            for _ in range(rng.randint(2, 8)):
                put(f'<li><a href="/{rng.randint(1, 99)}">{sentence(1, 3)}</a></li>', 0)
            html.append(f"</ul></{tag}>")

        def side(attr: str, tag: str = "div") -> None:
            html.append(f"<{tag}{attr}>")
            for _ in range(rng.randint(1, 3)):
                put(rng.choice(["<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>"]).format(sentence(1, 18)), 0)
            html.append(f"</{tag}>")

        def article() -> None:
            tag, attr = rng.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"'), ("section", ' class="story"')])
            bare = rng.random()
            if bare < 0.06:  # an article that is one block
                put(f"<{tag}{attr}>{prose()}</{tag}>", 1)
                return
            if bare < 0.1:  # or stands in the body itself
                put(f"<p>{prose()}</p>" if bare < 0.08 else f"<div>{prose()}</div>", 1)
                return
            html.append(f"<{tag}{attr}>")
            if rng.random() < 0.8:
                put(f"<h1>{sentence(2, 12)}</h1>", 1)
            for _ in range(rng.randint(1, 12)):
                kind = rng.random()
                if kind < 0.62:
                    put(f"<p>{prose()}</p>", 1)
                elif kind < 0.70:
                    put(f"<p><b>{prose()}<br>", 1)
                elif kind < 0.76:
                    put(f"<h2>{sentence(1, 6)}</h2>", 1)
                elif kind < 0.82:
                    html.append("<ul>")
                    for _ in range(rng.randint(1, 4)):
                        put(f"<li>{sentence(1, 12)}</li>", 1)
                    html.append("</ul>")
                elif kind < 0.86:
                    put(f"<blockquote>{prose()}</blockquote>", 1)
                elif kind < 0.89:
                    put(f"<pre>{sentence(2, 20)}</pre>", 1)
                elif kind < 0.92:
                    put(f'<p><a href="/x">{sentence(1, 5)}</a> {sentence(3, 20)}</p>', 1)
                elif kind < 0.94:
                    html.append("<table><tr>")
                    for _ in range(rng.randint(2, 4)):
                        put(f"<td>{sentence(1, 3)}</td>", 1)
                    html.append("</tr></table>")
                else:
                    attr2 = rng.choice(['class="ad"', 'class="share"', 'class="advert banner"', 'class="related"', 'class="newsletter"'])
                    put(f"<div {attr2}>{sentence(2, 14)}</div>", 0)
            if rng.random() < 0.1:
                comments()
            html.append(f"</{tag}>")

        def comments() -> None:
            tag = rng.choice(["section", "div", "ol"])
            html.append(f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "replies"])}">')
            if rng.random() < 0.5:
                put(f"<h3>{sentence(1, 3)}</h3>", 0)
            for _ in range(rng.randint(1, 5)):
                put(rng.choice(['<p class="comment">{}</p>', "<p>{}</p>", "<li>{}</li>", '<div class="comment">{}</div>']).format(prose()), 0)
            html.append(f"</{tag}>")

        html.append(f"<!DOCTYPE html><html><head><title>{sentence(2, 8)}</title><script>var t='</p>';</script></head><body>")
        if rng.random() < 0.3:
            side(rng.choice([' class="cookie-notice"', ' id="consent"', ' role="dialog" class="popup"']))
        if rng.random() < 0.5:
            side(rng.choice(["", ' class="site-header"']), "header")
        if rng.random() < 0.8:
            menu(*rng.choice([("nav", ""), ("nav", ' class="menu"'), ("div", ' class="navbar"'), ("div", ' id="breadcrumbs"')]))
        if rng.random() < 0.5:
            put(f'<div class="ad">{sentence(2, 20)}</div>', 0)
        if rng.random() < 0.25:
            side(rng.choice([' class="sidebar"', ""]), "aside")
        article()
        if rng.random() < 0.3:
            side(' class="sidebar"', rng.choice(["aside", "div"]))
        if rng.random() < 0.35:
            comments()
        if rng.random() < 0.25:
            html.append("<form>")
            put(f"<label>{sentence(1, 4)}</label>", 0)
            if rng.random() < 0.5:
                put(f"<p>{sentence(1, 9)}</p>", 0)
            put(f"<button>{sentence(1, 2)}</button>", 0)
            html.append("</form>")
        if rng.random() < 0.85:
            put(f"<footer>&copy; {sentence(2, 3)} &middot; {sentence(1, 16)}</footer>", 0) if rng.random() < 0.7 else side(' class="footer"')
        html.append("</body></html>")
        pages.append(("".join(html), labels))
    return pages


def train(pages: list[tuple[str, list[int]]] | None = None) -> Chain:
    """A chain trained on labelled pages (those of ``labelled_pages`` if none are given)."""
    found = []
    for html, labels in labelled_pages() if pages is None else pages:
        feats = [f for _, f in blocks(html)]
        if len(feats) == len(labels):
            found.append((feats, labels))
    return Chain().fit(found)


def main_text(html: str | None, model: Chain) -> str:
    """Article blocks in page order, joined by newlines; empty for a null or empty page."""
    found = blocks(html)
    labels = model.viterbi([f for _, f in found])
    return "\n".join(text for (text, _), label in zip(found, labels) if label)


def extract(pages: DataFrame, model: Chain, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row. Null and empty pages have the
    empty text, unclosed or malformed markup is read to its end, very long pages are
    read whole, of equally likely labels (a tie) a block is no article, repeated rows
    stay repeated, other columns are ignored, and an empty table gives an empty result."""
    shared = pages.sparkSession.sparkContext.broadcast((model.index, model.weight, model.move))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Chain()
        known.index, known.weight, known.move = shared.value
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                texts = [main_text(h.as_py(), known) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    small_batches(pages.sparkSession)
    kind = pages.schema[page_id].dataType.simpleString()
    chosen = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return chosen.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
