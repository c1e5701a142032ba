"""A tolerant HTML reader: the elements of a page in document order, with text and figures for each."""

from __future__ import annotations

import html
import re

import numpy as np

# possessive, so that an unfinished tag costs one look ahead; the second form takes tags with unpaired quotes
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Fixed lists of HTML element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = set("script style head title noscript template svg math iframe object canvas select option button audio video map textarea".split())
_RAW = set("script style title textarea noscript iframe template".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
_SCOPE = set("ul ol dl table tr td th div section article aside main nav header footer form body html".split())

#: Tokens of class, id and role attributes, by what they tell.
GROUPS = {
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip",
    "footer": "footer foot copyright colophon legal imprint",
    "header": "header masthead topbar logo brand hero",
    "side": "sidebar side aside rail widget complementary",
    "comment": "comment comments reply replies respond disqus discussion",
    "notice": "notice cookie cookies consent gdpr alert warning modal popup overlay toast",
    "form": "form newsletter subscribe signup login search input",
    "share": "share sharing social follow tweet",
    "related": "related recommended recommend more trending popular latest tags",
    "content": "article post entry content main body story text prose page blog",
}
_GROUP_OF = {t: 1 << k for k, words in enumerate(GROUPS.values()) for t in words.split()}
_TAG_GROUP = {"nav": "nav", "footer": "footer", "header": "header", "aside": "side", "form": "form", "article": "content", "main": "content", "dialog": "notice"}
_TAG_BITS = {t: 1 << list(GROUPS).index(g) for t, g in _TAG_GROUP.items()}
TAGS = "html body div section article main aside nav header footer form p h1 h2 h3 ul ol li table td blockquote pre figure a span b".split()
_TAG_AT = {t: k for k, t in enumerate(TAGS)}


class Page:
    """Elements in preorder: parallel lists tag, parent, end (one past the last descendant), own group bits,
    and runs (element, text) in page order."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.end, self.bits = ["html"], [-1], [1], [0]
        self.depth, self.above, self.silent, self.link, self.nth, self.kids = [0], [0], [False], [False], [0], [0]
        self.chars, self.marks = [0.0], [0]
        self.runs: list[tuple[int, str]] = []
        self.cuts: list[int] = []  # per run, how many block elements began or ended before it
        self._read(source or "")

    def _read(self, s: str) -> None:
        tag, parent, end, bits = self.tag, self.parent, self.end, self.bits
        stack = [0]
        open_at: dict[str, list[int]] = {}  # depths of the open elements of each name, and of those in _SCOPE
        scopes = open_at.setdefault("", [])
        at, n = 0, len(s)
        self._cut = 0

        def close(depth: int) -> None:
            for k in stack[depth:]:
                end[k] = len(tag)
                open_at[tag[k]].pop()
                if tag[k] in _SCOPE:
                    scopes.pop()
                self._cut += tag[k] not in INLINE and tag[k] not in SILENT
            del stack[depth:]

        def deepest(names) -> int:
            return max((open_at[t][-1] for t in names if open_at.get(t)), default=0)

        while at < n:
            m = _MARKUP.search(s, at) if s.find(">", at) >= 0 or s.find("<!", at) >= 0 else None
            stop = m.start() if m else n
            if stop > at:
                self._run(stack[-1], s[at:stop])
            if not m:
                break
            at = m.end()
            closes, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if name is None:
                continue
            name = name.lower()
            if closes:
                if name == "br":
                    self._run(stack[-1], " ")
                if open_at.get(name):
                    close(open_at[name][-1])
                continue
            if name == "html":
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self._run(stack[-1], " ")
                if name != "hr":
                    continue
            depth = max(deepest(_CLOSED_BY.get(name, ())), deepest(("p",)) if name in _CLOSES_P else 0)
            if depth and depth >= (scopes[-1] if scopes else 0):
                close(depth)
            k, up = len(tag), stack[-1]
            tag.append(name)
            parent.append(up)
            self.depth.append(self.depth[up] + 1)
            self.above.append(self.above[up] | bits[up])
            self.silent.append(self.silent[up] or name in SILENT)
            self.link.append(self.link[up] or name == "a")
            self.nth.append(self.kids[up])
            self.kids[up] += 1
            self.kids.append(0)
            self.chars.append(0.0)
            self.marks.append(0)
            end.append(k + 1)
            own = _TAG_BITS.get(name, 0)
            if "=" in attributes:
                for a in _ATTR.finditer(attributes):
                    for t in _TOKEN.findall(a[2] or a[3] or a[4] or ""):
                        own |= _GROUP_OF.get(t.lower(), 0)
            bits.append(own)
            self._cut += name not in INLINE and name not in SILENT
            if name in _RAW and not attributes.endswith("/"):
                over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(s, at)
                at = over.end() if over else n
            elif name not in VOID and not (attributes.endswith("/") and name in ("svg", "path")):
                open_at.setdefault(name, []).append(len(stack))
                if name in _SCOPE:
                    scopes.append(len(stack))
                stack.append(k)
        close(1)
        end[0] = len(tag)

    def _run(self, k: int, text: str) -> None:
        self.runs.append((k, text))
        self.cuts.append(self._cut)
        if not self.silent[k]:
            self.chars[k] += len(text) - text.count(" ") / 2
            self.marks[k] += text.count(".") + text.count(",") + text.count("?")

    def text(self, keep: np.ndarray) -> str:
        """Blocks of the elements kept, their white space made single, joined by blank lines. A block ends where
        any block element begins or ends."""
        tag, parent = self.tag, self.parent
        block_of: list[int] = [0] * len(tag)
        for k in range(1, len(tag)):
            block_of[k] = block_of[parent[k]] if tag[k] in INLINE else k
        blocks: list[str] = []
        now: list[str] = []
        last = (-1, 0)

        def flush() -> None:
            words = " ".join("".join(now).split())
            if words:
                blocks.append(words)
            now.clear()

        for (k, text), cut in zip(self.runs, self.cuts):
            if keep[k]:
                if (block_of[k], cut) != last:
                    flush()
                last = block_of[k], cut
                now.append(html.unescape(text))  # one run at a time: a reference does not reach across markup
        flush()
        return "\n\n".join(blocks)


def figures(pages: list[Page]) -> np.ndarray:
    """One row of features per element of all pages, in order."""
    size = np.array([len(p.tag) for p in pages])
    root = np.repeat(size.cumsum() - size, size)
    n = len(root)
    every = lambda name, kind: np.concatenate([np.array(getattr(p, name), dtype=kind) for p in pages])
    own = np.arange(n)
    up = np.maximum(every("parent", np.int64), 0) + root
    end = every("end", np.int64) + root
    bits, above, link = every("bits", np.int64), every("above", np.int64), every("link", bool)
    chars, marks = every("chars", float), every("marks", float)
    total = lambda x: (c := np.r_[0, x.cumsum()])[end] - c[own]
    below, below_linked, below_marks = total(chars), total(chars * link), total(marks)
    page = np.maximum(1.0, below[root])
    before = (np.r_[0, chars.cumsum()[:-1]] - np.r_[0, chars.cumsum()][root]) / page
    kids = every("kids", float)
    brothers = np.where(own == root, 1, kids[up])
    known = np.array([_TAG_AT.get(t, -1) for p in pages for t in p.tag])
    kinds: dict[str, int] = {}
    kind = np.array([kinds.setdefault(t, len(kinds)) for p in pages for t in p.tag])
    _, same, count = np.unique(up * len(kinds) + kind, return_inverse=True, return_counts=True)
    like = np.where(own == root, 0, count[same] / np.maximum(brothers, 1))
    density, tags = below_linked / np.maximum(below, 1), end - own
    tag = np.zeros((n, len(TAGS)))
    tag[own[known >= 0], known[known >= 0]] = 1
    flags = np.arange(len(GROUPS))
    stats = np.c_[every("depth", float), every("nth", float), brothers, like, np.log1p(below), np.log1p(chars), density, density[up], 100 * tags / np.maximum(below, 1), 100 * below_marks / np.maximum(below, 1), before, below / page, below / np.maximum(below[up], 1), np.log1p(tags), kids]
    return np.c_[tag, (bits[:, None] >> flags) & 1, (above[:, None] >> flags) & 1, stats].astype(np.float32)
