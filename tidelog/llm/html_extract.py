"""Main-text extraction: gradient-boosted trees over DOM-node features with hierarchical decoding.

Each element gets a probability of belonging to the article from boosted trees over its tag, attribute
tokens, depth, siblings and the density of its subtree. The most likely labelling in which nothing below a
dropped element is kept is then found bottom-up, so ancestors and descendants never contradict each other.
The trees are trained on pages that a seeded generator writes together with their labels.
"""

from __future__ import annotations

import functools
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_dom import Page, figures


@dataclass
class Trees:
    """Boosted trees of one depth as flat arrays: feature, threshold per inner node, value per leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray, chunk: int = 2048) -> np.ndarray:
        n_leaves = self.value.shape[1]
        out = np.full(len(x), self.bias)
        for first in range(0, len(x), chunk):
            flat = np.ascontiguousarray(x[first : first + chunk])
            row = np.arange(len(flat)) * x.shape[1]
            flat = flat.ravel()
            for f, t, v in zip(self.feature, self.threshold, self.value):
                at = (flat[row + f[0]] > t[0]) + 1
                for _ in range(n_leaves.bit_length() - 2):
                    at = 2 * at + 1 + (flat[row + f[at]] > t[at])
                out[first : first + chunk] += v[at - (n_leaves - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 32, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on histograms of `bins` quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    n, width = binned.shape
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    z = np.full(n, bias)
    inner = (1 << depth) - 1
    features, thresholds, values = [], [], []
    flat = binned + np.arange(width) * bins
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            for k in range(first, 2 * first + 1):
                on = np.flatnonzero(node == k)
                if len(on) < 8:
                    node[on] = 2 * k + 1
                    continue
                cells = flat[on].ravel()
                gs = np.bincount(cells, np.repeat(g[on], width), width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(cells, np.repeat(h[on], width), width * bins).reshape(width, bins).cumsum(axis=1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (total_g - gs) ** 2 / (total_h - hs + l2) - total_g**2 / (total_h + l2)
                for f, e in enumerate(edges):
                    gain[f, len(e) :] = -1
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] > 1e-6:
                    feature[k], threshold[k] = f, edges[f][b]
                node[on] = 2 * k + 1 + (x[on, feature[k]] > threshold[k])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        z += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), bias)


def decode(parent: list[int], silent: list[bool], odds: np.ndarray) -> np.ndarray:
    """Most likely labels in which every element kept has a kept parent; silent elements are dropped."""
    n = len(parent)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    keep, drop = yes.tolist(), no.tolist()
    for k in range(n - 1, 0, -1):
        p = parent[k]
        drop[p] += drop[k]
        keep[p] += drop[k] if silent[k] else max(keep[k], drop[k])
    out = np.zeros(n, dtype=bool)
    out[0] = keep[0] >= drop[0]
    for k in range(1, n):
        out[k] = out[parent[k]] and not silent[k] and keep[k] >= drop[k]
    return out


class _Writer:
    """Writes a random page; every element carries data-y, 1 where it belongs to the article."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(low, high)):
            w = "".join(r.choice("aeioubcdfghlmnprstvwéäñ") for _ in range(r.randint(1, 11)))
            out.append(w + (r.choice(".,") if r.random() < 0.15 else ""))
        return " ".join(out).capitalize()

    def e(self, tag: str, y: int, inner: str, attr: str = "", close: bool = True) -> str:
        return f'<{tag}{" " + attr if attr else ""} data-y="{y}">{inner}' + (f"</{tag}>" if close else "")

    def name(self, options: str) -> str:
        r = self.r
        token = r.choice(options.split())
        token = r.choice([token, f"{token}-{r.choice('box wrap list item inner top 1 2'.split())}", f"site-{token}", token])
        return r.choice([f'class="{token}"', f'id="{token}"', f'class="{token} c{r.randint(1, 99)}"'])

    def links(self, n: int, y: int = 0) -> str:
        items = [self.e("li", y, self.e("a", y, self.words(1, 3), f'href="/{i}"')) for i in range(n)]
        return self.e("ul", y, "".join(items)) if self.r.random() < 0.8 else "".join(self.e("a", y, self.words(1, 2), 'href="/x"') for _ in range(n))

    def boilerplate(self) -> str:
        r = self.r
        prose = lambda: self.e("p", 0, self.words(3, 40)) if r.random() < 0.5 else self.words(2, 40)
        kind = r.randrange(10)
        if kind == 0:
            return self.e("nav", 0, self.links(r.randint(1, 9)), r.choice(["", self.name("nav menu navbar")]))
        if kind == 1:
            return self.e("div", 0, self.links(r.randint(2, 9)), r.choice(["", self.name("menu nav breadcrumb pagination")]))
        if kind == 2:
            return self.e("header", 0, self.e(r.choice(["h1", "div", "span"]), 0, self.words(1, 5)) + r.choice(["", self.links(3), prose()]), r.choice(["", self.name("header masthead topbar")]))
        if kind == 3:
            return self.e(r.choice(["footer", "footer", "div"]), 0, "&copy; " + prose() + r.choice(["", self.links(4)]), self.name("footer copyright legal"))
        if kind == 4:
            return self.e("footer", 0, "&copy; " + self.words(2, 15))
        if kind == 5:
            return self.e("aside", 0, self.e("h3", 0, self.words(1, 3)) + r.choice([self.links(4), prose(), prose() + prose()]), r.choice(["", self.name("sidebar widget related")]))
        if kind == 6:
            return self.e(r.choice(["div", "section", "aside"]), 0, prose() + r.choice(["", prose()]), self.name("ad ads advert sponsored banner promo"))
        if kind == 7:
            return self.e("div", 0, prose() + self.e("a", 0, self.words(1, 2)), self.name("cookie consent notice alert popup modal"))
        if kind == 8:
            return self.e("form", 0, self.e("label", 0, self.words(1, 4)) + '<input name="q">' + prose(), r.choice(["", self.name("newsletter search login subscribe")]))
        return self.e("div", 0, r.choice([self.links(4), prose(), self.e("h4", 0, self.words(1, 4)) + self.links(3)]), self.name("share social related recommended sidebar trending"))

    def comments(self) -> str:
        one = lambda: self.e(self.r.choice(["div", "li", "article"]), 0, self.e("span", 0, self.words(1, 2)) + self.e("p", 0, self.words(3, 60)), self.name("comment reply"))
        return self.e(self.r.choice(["section", "div"]), 0, self.e("h3", 0, self.words(1, 2)) + "".join(one() for _ in range(self.r.randint(1, 6))), self.name("comments replies discussion"))

    def article(self) -> str:
        r = self.r
        parts = [self.e(r.choice(["h1", "h1", "h2"]), 1, self.words(1, 12))] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            k = r.random()
            text = self.words(*r.choice([(1, 4), (5, 30), (20, 120), (60, 200)]))
            if r.random() < 0.25:
                text += " " + self.e("a", 1, self.words(1, 3), 'href="#"') + " " + self.words(2, 10)
            if r.random() < 0.2:
                text = self.e(r.choice(["b", "em", "span", "strong"]), 1, self.words(1, 9), close=r.random() < 0.7) + " " + text
            if k < 0.75:
                parts.append(self.e("p", 1, text + r.choice(["", "", "<br>"]), close=r.random() < 0.8))
            elif k < 0.82:
                parts.append(self.e("h2", 1, self.words(1, 6)))
            elif k < 0.88:
                parts.append(self.e(r.choice(["ul", "ol"]), 1, "".join(self.e("li", 1, self.words(2, 20)) for _ in range(r.randint(2, 6)))))
            elif k < 0.92:
                parts.append(self.e("blockquote", 1, self.e("p", 1, text)))
            elif k < 0.95:
                parts.append(self.e("table", 1, "".join(self.e("tr", 1, self.e("td", 1, self.words(1, 5)) + self.e("td", 1, self.words(1, 5))) for _ in range(3))))
            elif k < 0.97:
                parts.append(self.e("pre", 1, text))
            else:
                parts.append(self.e("div", 0, self.words(3, 20), self.name("ad sponsored share related")))
        inner = "".join(parts)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            inner = self.e(r.choice(["div", "section", "div"]), 1, inner, r.choice(["", "", self.name("content post entry article main story"), f'class="c{r.randint(1, 99)}"']))
        if r.random() < 0.12:
            return inner
        return self.e(*r.choice([("article", 1, inner), ("article", 1, inner), ("main", 1, inner), ("div", 1, inner, self.name("content post entry main")), ("div", 1, inner)]))

    def page(self) -> str:
        r = self.r
        most = r.choice([0, 2, 4, 4])
        before = [self.boilerplate() for _ in range(r.randint(0, most))]
        after = [self.boilerplate() for _ in range(r.randint(0, most))]
        if r.random() < 0.3:
            after.insert(0, self.comments())
        body = "".join(before) + self.article() + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = self.e("div", 1, body, r.choice(["", self.name("page wrap container"), 'id="root"']))
        return f'<html><head><title>x</title></head><body data-y="1">{body}' + r.choice(["</body></html>", ""])


class _Labelled(Page):
    def __init__(self, source: str):
        import re

        super().__init__(source)
        found = re.findall(r'<([a-z0-9]+)[^>]*data-y="(\d)"', source)
        kept = [k for k, t in enumerate(self.tag) if t not in ("html", "head", "title", "hr")]
        if [self.tag[k] for k in kept] != [t for t, _ in found if t not in ("input",)]:
            raise ValueError("labels and elements differ")
        self.y = np.zeros(len(self.tag))
        self.y[0] = 1
        self.y[kept] = [int(y) for _, y in found]


@functools.lru_cache(maxsize=4)
def train(pages: int = 600, seed: int = 17, **options) -> Trees:
    """Trees fitted on `pages` generated pages; the same for the same seed."""
    got = [_Labelled(_Writer(seed * 100_003 + k).page()) for k in range(pages)]
    x = figures(got)
    return boost(x, np.concatenate([p.y for p in got]), **options)


def extract(sources: list[str | None], model: Trees) -> list[str]:
    """Main text of each page; empty where there is none."""
    pages = [Page(s) for s in sources]
    odds = model.log_odds(figures(pages)) if pages else np.zeros(0)
    out, at = [], 0
    for p in pages:
        out.append(p.text(decode(p.parent, p.silent, odds[at : at + len(p.tag)])))
        at += len(p.tag)
    return out


def extract_main_text(pages: DataFrame, model: Trees | None = None, batch: int = 200) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row.

    Null and empty pages have an empty text; rows are read each on their own, whole, so repeats, ties and
    null ids need no rule; an empty table gives no rows; only page_id, url and html are read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = extract(part.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
