"""Main text of HTML pages: gradient-boosted trees over DOM-node features, decoded over the tree.

A tolerant parser turns a page into nodes in document order. Features of a node
are its tag, attribute tokens of itself and its ancestors, depth, densities of
text, links, punctuation and nodes in its subtree, and its place and share among its siblings. Boosted trees give each
node the probability of being main text. Decoding then picks, over the whole
tree, the likeliest labelling in which every path from the root runs outside*,
inside*, left-out*: so nothing outside the main text has main text both above and below it, and what is left out stays out
with all it holds. It is exact, by one pass up and one pass down the tree.

The trees are fitted here, on pages made by `training_page` from a seed (layouts, names and noise vary, down to bare
paragraphs and loose text; their node labels are known), so the model is the same wherever it is fitted.

Null and empty pages give empty text. A page without any element is main text as a whole.
Scripts, styles, templates, embedded frames, comments and titles never are; what other elements hold is judged by the trees. A script or style that
is not closed goes on to the end of the page, as in browsers; of other such elements only the tag is passed over. White space, also within references, is that of
str.split; a reference does not go on behind a tag. A page is parsed and labelled whole in one task, in time and memory in proportion to its length, however
deep it is. Repeated rows are rows of their own; an empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import cut_rows

# Fixed values of HTML: elements without content, with raw content, and that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag of the first kind ends an open element of the second, up to one of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr"}, {"table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "head", "body"}

TAGS = "article main section div p heading list item nav header footer aside form control table figure quote pre link inline body root other".split()
_GROUP = {
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "dl": "list", "menu": "list",
    "li": "item", "dt": "item", "dd": "item", "button": "control", "label": "control", "select": "control", "option": "control", "textarea": "control", "fieldset": "form", "table": "table", "tbody": "table", "thead": "table",
    "tr": "table", "td": "table", "th": "table", "figcaption": "figure", "blockquote": "quote", "code": "pre", "a": "link",
    **dict.fromkeys("b i em strong span u s small sub sup br img cite q mark abbr time font".split(), "inline"),
}
_TAG = {t: k for k, t in enumerate(TAGS)}
_TAG |= {t: _TAG[g] for t, g in _GROUP.items()}
FOR = frozenset("article content post entry main body story text maincontent articlebody prose page".split())
AGAINST = frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer foot bottom sidebar side aside rail ad ads advert advertisement adbox sponsor sponsored banner promo"
    " cookie cookies consent notice alert popup modal comment comments commentlist discussion reply replies respond share sharing social related recommended"
    " newsletter subscribe signup login form search breadcrumb breadcrumbs widget toolbar pagination pager tags meta copyright legal disclaimer hidden skip".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*+")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*+>", re.I) for t in RAW}
_LETTERS = re.compile(r"[.!?,;:]")


class Page:
    """Nodes in document order and the pieces of text between tags. Node 0 is the root, and node 1 the body, which a page has even if it does not say so."""

    __slots__ = ("parent", "depth", "tag", "name", "good", "bad", "node", "piece", "block")

    def __init__(self):
        self.parent, self.depth, self.tag, self.name, self.good, self.bad = [-1, 0], [0, 1], [_TAG["root"], _TAG["body"]], ["", "body"], [0, 0], [0, 0]
        self.node: list[int] = []  # of each piece of text: its node, the text, and the number of its block
        self.piece: list[str] = []
        self.block: list[int] = []


@cache
def _attributes(text: str) -> tuple[int, int]:
    tokens = [p.lower() for m in _ATTR.finditer(text) for p in _PART.findall(m[1] or m[2] or m[3] or "")]
    return sum(t in FOR for t in tokens), sum(t in AGAINST for t in tokens)


def parse(source: str) -> Page:
    page = Page()
    last = source.rfind(">") + 1  # no tag can end after it
    body, rest = source[:last], source[last:]
    cut = re.search(r"<[a-zA-Z/!?]", rest)
    rest = rest[: cut.start()] if cut else rest
    stack, at, block, end = [0, 1], 0, 0, len(body)
    names = page.name
    unclosed: set[str] = set()

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            page.node.append(stack[-1])
            page.piece.append(piece)
            page.block.append(block)
        elif piece and page.node and page.block[-1] == block:
            page.piece[-1] += " "

    while at < end:
        m = _TOKEN.search(body, at)
        if m is None:
            break
        text(body[at : m.start()])
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name in BLOCK:
                block += 1
            if name in ("html", "body"):
                continue
            for k in range(len(stack) - 1, 1, -1):
                if names[stack[k]] == name:
                    del stack[k:]
                    break
                if names[stack[k]] in ("article", "table") and name not in BLOCK:
                    break
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                close = None if name in unclosed else _RAW_END[name].search(body, at)
                if close:
                    at = close.end()
                elif name in ("script", "style"):
                    at, rest = end, ""
                else:
                    unclosed.add(name)
            continue
        if name in BLOCK:
            block += 1
        if name in ("html", "body"):
            page.good[1], page.bad[1] = (a + b for a, b in zip((page.good[1], page.bad[1]), _attributes.__wrapped__(attrs), strict=True))
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if names[stack[k]] == "p":
                    del stack[k:]
                    break
                if names[stack[k]] in BLOCK:
                    break
        ends = CLOSES.get(name)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if names[stack[k]] in ends[0]:
                    del stack[k:]
                    break
                if names[stack[k]] in ends[1]:
                    break
        if name in VOID:
            if name == "br":
                text(" ")
            continue
        good, bad = _attributes(attrs) if len(attrs) > 4 and len(attrs) < 400 else (0, 0) if len(attrs) <= 4 else _attributes.__wrapped__(attrs)
        page.depth.append(page.depth[stack[-1]] + 1)
        page.parent.append(stack[-1])
        page.tag.append(_TAG.get(name, _TAG["other"]))
        page.name.append(name)
        page.good.append(good)
        page.bad.append(bad)
        if not (attrs.endswith("/") and name not in BLOCK):
            stack.append(len(page.parent) - 1)
    text(body[at:] + rest if at < end else rest)
    return page


FEATURES = (
    *("is_" + t for t in TAGS), *("under_" + t for t in TAGS),
    "good", "bad", "good_above", "bad_above", "depth", "nodes", "chars", "words", "own_chars", "link_share", "punctuation", "chars_a_node", "words_a_node",
    "page_share", "parent_share", "siblings", "place", "same_tag", "paragraphs", "headings", "items", "bad_below", "good_below", "parent_good", "parent_bad", "after_most", "article_page",
)


def by_depth(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, from the roots down."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else []


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of features for each node of all pages; and parents (or -1), depths and first nodes of pages."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    flat = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
    parent, tag, good, bad = flat("parent"), flat("tag"), flat("good").astype(float), flat("bad").astype(float)
    root = parent < 0
    parent = np.where(root, -1, parent + np.repeat(first, sizes))
    up = np.where(root, np.arange(n), parent)
    depth = flat("depth")
    pieces = [x for p in pages for x in p.piece]
    node = np.array([x + f for p, f in zip(pages, first.tolist(), strict=True) for x in p.node], np.int64)
    chars, words, stops = (np.bincount(node, np.array(v, float), n) if len(pieces) else np.zeros(n) for v in ([len(x) for x in pieces], [x.count(" ") + 1 for x in pieces], [x.count(".") + x.count(",") for x in pieces]))
    own = chars.copy()
    linked = np.where(tag == _TAG["link"], chars, 0.0)
    counts = np.stack([np.ones(n), chars, words, stops, linked, (tag == _TAG["p"]).astype(float), (tag == _TAG["heading"]).astype(float), (tag == _TAG["item"]).astype(float), bad, good], axis=1)
    total = counts.copy()
    link_below = np.zeros(n)
    levels = by_depth(depth)
    for rows in levels[:0:-1]:
        np.add.at(total, up[rows], total[rows])
    above_good, above_bad = good.copy(), bad.copy()
    for rows in levels[1:]:
        above_good[rows] += above_good[up[rows]]
        above_bad[rows] += above_bad[up[rows]]
    link_below = np.where(tag == _TAG["link"], total[:, 1], total[:, 4])
    siblings = np.bincount(up[~root], minlength=n)[up].astype(float)
    order = np.lexsort((np.arange(n), up))
    place = np.empty(n)
    place[order] = np.arange(n) - np.searchsorted(up[order], up[order])
    pair = up * len(TAGS) + tag
    same = np.bincount(pair, minlength=n * len(TAGS))[pair].astype(float)
    page_of = np.repeat(np.arange(len(pages)), sizes)
    page_chars = total[first, 1][page_of] if n else np.zeros(0)
    share = total[:, 1] / np.maximum(1, total[up, 1])
    # Of the siblings, the one with most text: whether a node comes after it.
    big = np.lexsort((-total[:, 1], up))
    lead = np.zeros(n, np.int64)
    lead[up[big][::-1]] = big[::-1]
    x = np.zeros((n, len(FEATURES)), np.float32)
    x[np.arange(n), tag] = 1
    x[np.arange(n), len(TAGS) + tag[up]] = 1
    has_article = np.bincount(page_of, np.isin(tag, [_TAG["article"], _TAG["main"]]), len(pages))[page_of] > 0
    cols = [
        good, bad, above_good - good, above_bad - bad, depth, total[:, 0], total[:, 1], total[:, 2], own, link_below / np.maximum(1, total[:, 1]), total[:, 3] / np.maximum(1, total[:, 2]),
        total[:, 1] / total[:, 0], total[:, 2] / total[:, 0], total[:, 1] / np.maximum(1, page_chars), share, siblings, place / np.maximum(1, siblings), same, total[:, 5], total[:, 6], total[:, 7],
        total[:, 8] - bad, total[:, 9] - good, good[up], bad[up], np.arange(n) > lead[up], has_article,
    ]
    x[:, 2 * len(TAGS) :] = np.stack(cols, axis=1)
    return x, parent, depth, first


class Trees:
    """Boosted regression trees of one depth for the logistic loss, on binned features."""

    def __init__(self, depth: int = 5, rounds: int = 60, rate: float = 0.25, bins: int = 24, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge = depth, rounds, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        n, f = x.shape
        self.edges = []
        binned = np.zeros((f, n), np.int64)
        for j in range(f):
            e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1]))
            self.edges.append(e.astype(np.float32))
            binned[j] = np.searchsorted(self.edges[j], x[:, j], "left")
        self.bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        z = np.full(n, self.bias)
        inner, b = (1 << self.depth) - 1, self.bins
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.limit = np.full((self.rounds, inner), np.inf, np.float32)
        self.leaf = np.zeros((self.rounds, inner + 1))
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                k = 1 << level
                best = np.zeros(k)
                pick, cut = np.zeros(k, np.int64), np.full(k, b)
                for j in range(f):
                    if not len(self.edges[j]):
                        continue
                    key = node * b + binned[j]
                    gs, hs = (np.bincount(key, w, k * b).reshape(k, b).cumsum(axis=1) for w in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(k), top]
                    won = value > best + 1e-9
                    best[won], pick[won], cut[won] = value[won], j, top[won]
                at = (1 << level) - 1 + np.arange(k)
                self.feature[t, at] = pick
                self.limit[t, at] = [self.edges[j][c] if c < len(self.edges[j]) else np.inf for j, c in zip(pick.tolist(), cut.tolist(), strict=True)]
                node = node * 2 + (binned[pick[node], np.arange(n)] > cut[node])
            gs, hs = (np.bincount(node, w, inner + 1) for w in (g, h))
            self.leaf[t] = -self.rate * gs / (hs + self.ridge)
            z += self.leaf[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.limit[t][node])
            z += self.leaf[t][node - (1 << self.depth) + 1]
        return z


def decode(odds: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Nodes that are inside, in the likeliest labelling whose paths run outside*, inside*, left-out*."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    inside, out, left = yes.copy(), no.copy(), no.copy()
    levels = by_depth(depth)
    for rows in levels[:0:-1]:
        up = parent[rows]
        np.add.at(left, up, left[rows])
        np.add.at(inside, up, np.maximum(inside[rows], left[rows]))
        np.add.at(out, up, np.maximum(out[rows], inside[rows]))
    state = np.zeros(len(odds), np.int8)  # 0 outside, 1 inside, 2 left out; the root is outside
    for rows in levels[1:]:
        above = state[parent[rows]]
        state[rows] = np.where(above == 2, 2, np.where(above == 1, np.where(inside[rows] >= left[rows], 1, 2), np.where(inside[rows] > out[rows], 1, 0)))
    return state == 1


def assemble(page: Page, inside: np.ndarray) -> str:
    if len(page.parent) == 2:  # no element at all
        inside = np.ones(2, bool)
    out: list[str] = []
    last = -1
    for node, piece, block in zip(page.node, page.piece, page.block, strict=True):
        if block != last:
            out.append(" ")
            last = block
        if inside[node]:
            out.append(_html.unescape(piece) if "&" in piece else piece)
    return " ".join("".join(out).split())


class Extractor:
    def __init__(self, trees: Trees):
        self.trees = trees

    def __call__(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        if not pages:
            return []
        x, parent, depth, first = features(pages)
        inside = decode(self.trees.predict(x), parent, depth)
        return [assemble(p, inside[f : f + len(p.parent)]) for p, f in zip(pages, first.tolist(), strict=True)]


MARK = "\ue000"  # before every word of the main text of a training page

# Syllables of the training pages' words.
_SYLLABLES = "ka lo mi ren tos ver ish an dor el fa gu hem in jo ku la ment no per qui ros sa ta un vi wa xe yo zen th er on ing".split()


def training_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page, its main text marked, and the pieces of that text; made by choices of layout, names and noise."""

    def word() -> str:
        return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(3, 14).capitalize() + rng.choice(". . . ! ? .".split()) for _ in range(rng.randint(a, b)))

    named = rng.random() < 0.75  # else class names say nothing

    def attr(*names: str) -> str:
        if rng.random() < (0.1 if named else 0.7):
            return "" if rng.random() < 0.5 else f' class="{word()}{rng.randint(0, 99)}"'
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}{rng.choice(["", "", " " + word(), "-" + word()])}"'

    def links(a: int, b: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(a, b)))

    def menu() -> str:
        t = rng.choice(["nav", "nav", "div", "ul"])
        return f"<{t}{attr('nav', 'menu', 'navbar', 'navigation')}>{'<ul>' if t != 'ul' else ''}{links(3, 9)}{'</ul>' if t != 'ul' else ''}</{t}>"

    def head() -> str:
        t = rng.choice(["header", "header", "div"]) if named else "header"  # else nothing would tell it from a story's heading
        inner = rng.choice([f"<a href='/'>{words(1, 3)}</a>", f"<h2>{words(1, 3)}</h2>", f"<p>{words(2, 6)}</p>", f"<h1>{words(1, 3)}</h1>"])
        return f"<{t}{attr('header', 'masthead', 'topbar')}>{inner}{menu() if rng.random() < 0.5 else ''}</{t}>"

    def foot() -> str:
        t = rng.choice(["footer", "footer", "footer", "div"]) if named else "footer"
        inner = rng.choice([f"&copy; {words(1, 3)} &middot; {sentences(1, 4)}", f"<p>{sentences(1, 2)}</p><ul>{links(2, 5)}</ul>", f"<p>&copy; {words(2, 5)}</p>", f"<a href='/x'>{word()}</a> {words(2, 9)}."])
        return f"<{t}{attr('footer', 'foot', 'bottom', 'copyright')}>{inner}</{t}>"

    def advert() -> str:
        t = rng.choice(["div", "div", "aside", "section", "p"])
        inner = sentences(1, 3) if t == "p" or rng.random() < 0.6 else f"<p>{sentences(1, 3)}</p><a href='/buy'>{words(1, 3)}</a>"
        name = rng.choice(["ad", "ads", "advert", "sponsored", "promo", "banner"])
        return f'<{t} class="{name}">{inner}</{t}>' if t in ("div", "p", "section") else f"<{t}{attr(name)}>{inner}</{t}>"

    def notice() -> str:
        return f'<div class="{rng.choice(["cookie", "notice", "cookie-consent", "alert", "popup"])}">{rng.choice(["", "<p>"])}{sentences(1, 3)}<button>{words(1, 2)}</button></div>'

    def form() -> str:
        return f"<form{attr('newsletter', 'signup', 'search', 'login')}><label>{words(1, 4)}</label><input name=q><p>{sentences(1, 2)}</p><button>{word()}</button></form>"

    def side() -> str:
        t = rng.choice(["aside", "aside", "div"])
        inner = "".join(rng.choice([lambda: f"<h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul>", lambda: f"<h3>{words(1, 3)}</h3><p>{sentences(1, 3)}</p>", advert, form])() for _ in range(rng.randint(1, 3)))
        return f"<{t} class='sidebar'>{inner}</{t}>" if t == "div" else f"<{t}{attr('sidebar', 'rail', 'widget')}>{inner}</{t}>"

    def stray() -> str:
        """What a page holds besides: fallbacks, pictures, choices."""
        return rng.choice([
            lambda: f"<noscript>{sentences(1, 1)}</noscript>", lambda: f"<select><option>{word()}</option><option>{word()}</option></select>", lambda: f"<svg><title>{word()}</title><text>{word()}</text></svg>",
            lambda: f"<iframe src=x>{sentences(1, 1)}</iframe>", lambda: "<img src=x>", lambda: "<hr>", lambda: f"<form><textarea>{words(1, 4)}</textarea><button>{word()}</button></form>", lambda: f"<button>{words(1, 2)}</button>",
        ])()

    def share() -> str:
        return f'<div class="{rng.choice(["share", "social", "related", "tags", "breadcrumb"])}"><ul>{links(2, 5)}</ul></div>'

    def comments() -> str:
        t = rng.choice(["section", "div"])
        item = rng.choice(["li", "div", "article"])
        one = lambda: f'<{item} class="comment"><b>{word()}</b><p>{sentences(1, 4)}</p></{item}>'
        body = "".join(one() for _ in range(rng.randint(1, 6)))
        return f'<{t} {rng.choice(["class", "id"])}="comments"><h3>{words(1, 2)}</h3>{"<ol>" + body + "</ol>" if item == "li" else body}{form() if rng.random() < 0.3 else ""}</{t}>'

    said: list[str] = []

    def kept(text: str) -> str:
        said.append(text)
        return " ".join(MARK + w for w in text.split())

    def heading(t: str, text: str) -> str:
        return f"<{t}><a href='/{word()}'>{kept(text)}</a></{t}>" if rng.random() < 0.12 else f"<{t}>{kept(text)}</{t}>"

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.72:
            text = kept(sentences(1, 8))
            if rng.random() < 0.25:
                a, _, b = text.partition(" ")
                text = f"<b>{a}</b> {b}" if rng.random() < 0.5 else f"<b>{text}<br>"
            if rng.random() < 0.15:
                text = text.replace(" ", f' <a href="/{word()}">', 1).rstrip() + "</a>" if " " in text and "<" not in text else text
            return f"<p>{text}" + ("</p>" if rng.random() < 0.85 else "")
        if kind < 0.8:
            return heading("h2", words(1, 6))
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{kept(sentences(1, 2))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{kept(sentences(1, 3))}</p></blockquote>"
        if kind < 0.93:
            return f"<pre>{kept(words(4, 20))}</pre>"
        if kind < 0.96:
            return f"<figure><img src=x><figcaption>{kept(words(3, 9))}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{kept(words(1, 3))}</td><td>{kept(words(1, 3))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"

    def loose() -> str:
        """A paragraph without an element of its own, or in one that says little."""
        text = kept(sentences(1, 5))
        if rng.random() < 0.3:
            a, _, b = text.partition(" ")
            text = f"<{(t := rng.choice('b i em strong span a'.split()))}>{a}</{t}> {b}"
        return rng.choice([f"{text}<br><br>", f"{text}<br>", f"<div>{text}</div>", f"<span>{text}</span><br>", f"{text}<p>", f"<font>{text}</font><hr>", f"<center>{text}</center>"])

    def bare() -> str:
        """A page, or a piece of one, with little or nothing around its text."""
        headline = heading(rng.choice(["h1", "h1", "h2", "h3"]), words(1, 8)) if rng.random() < 0.5 else ""
        one = rng.choice([paragraph, paragraph, loose, lambda: f"<p>{kept(sentences(1, 3))}</p>", lambda: kept(sentences(1, 4)) + " "])
        parts = [headline, *[one() if rng.random() < 0.9 else paragraph() for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 9]))]]
        if rng.random() < 0.15:
            parts.insert(rng.randrange(len(parts) + 1), stray())
        if rng.random() < 0.06:  # a page of a word or two
            said.clear()
            parts = [f"<p>{kept(words(1, 3) + '.')}</p>"]
        inner = "".join(parts)
        t = rng.choice(["", "", "", "article", "main", "div", "section", "center", "span", "blockquote", "td"])
        if t == "td":
            inner = f"<table><tr>{'<td>' + links(2, 5).replace('li>', 'div>') + '</td>' if rng.random() < 0.6 else ''}<td>{inner}</td></tr></table>"
        elif t:
            inner = f"<{t}{attr('content', 'text', 'post', 'article', 'main') if rng.random() < 0.3 else ''}>{inner}</{t}>"
            for _ in range(rng.choice([0, 0, 1, 2])):
                inner = f"<div>{inner}</div>"
        if rng.random() < 0.35:
            inner = rng.choice([head, menu, advert, notice, lambda: f"<header><h1>{words(1, 4)}</h1></header>"])() + inner
        if rng.random() < 0.35:
            inner += rng.choice([foot, foot, comments, share, form, side, advert])()
        return rng.choice([inner, inner, f"<html><body>{inner}</body></html>", f"<body>{inner}", f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{inner}</body></html>"])

    def story() -> str:
        t = rng.choice(["article", "article", "article", "main", "div", "section"])
        parts = [heading("h1", words(2, 10))] if rng.random() < 0.85 else []
        if rng.random() < 0.15:
            parts.insert(0, share())
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14, 25])):
            parts.append(paragraph())
            if rng.random() < 0.06:
                parts.append(rng.choice([advert, share, notice, form, stray])())
        inner = "".join(parts)
        if rng.random() < 0.25:
            inner = f"<div{attr('content', 'body', 'text', 'entry-content')}>{inner}</div>"
        if rng.random() < 0.15:
            inner += comments()
        elif rng.random() < 0.2:
            inner += share()
        names = attr("article", "content", "post", "entry", "story", "main") if t in ("div", "section") else rng.choice(["", attr("post", "content")])
        return f"<{t}{names}>{inner}</{t}>"

    if rng.random() < 0.33:
        return bare(), said
    before = [x() for x, p in ((notice, 0.15), (head, 0.5), (menu, 0.6), (share, 0.15), (advert, 0.4)) if rng.random() < p]
    middle = [story()]
    if rng.random() < 0.3:
        middle.insert(rng.choice([0, 1]), side())
    after = [x() for x, p in ((comments, 0.25), (share, 0.2), (form, 0.15), (advert, 0.15), (notice, 0.1), (foot, 0.85)) if rng.random() < p]
    wrap = rng.random()
    core = "".join(middle)
    if wrap < 0.25:
        core = f"<div{rng.choice(['', attr('container', 'wrapper', 'page', 'layout')])}>{core}</div>"
    body = "".join(before) + core + "".join(after)
    if wrap > 0.9:
        body = f"<div id=wrapper>{body}</div>"
    title = f"<head><title>{words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    end = "</body></html>" if rng.random() < 0.8 else ""
    return f"<!DOCTYPE html><html>{title}<body>{body}{end}", said


def _labels(page: Page) -> np.ndarray:
    """Inside are the least element that holds all main text, what holds no more text than it, and what in it is main text for the greater part."""
    main, all_, own = np.zeros(len(page.parent)), np.zeros(len(page.parent)), np.zeros(len(page.parent))
    for k, (node, piece) in enumerate(zip(page.node, page.piece, strict=True)):
        good, plain = MARK in piece, piece.replace(MARK, "")
        page.piece[k] = plain
        own[node] += len(plain) * (1 if good else -1)
        while node >= 0:
            all_[node] += len(plain)
            main[node] += len(plain) * good
            node = page.parent[node]
    parent = np.array(page.parent)
    story = int(np.flatnonzero(main == main[0])[-1])
    while parent[story] > 1 and all_[parent[story]] == all_[story]:
        story = parent[story]
    under = np.zeros(len(parent), bool)
    under[story] = True
    for k in range(story + 1, len(parent)):
        under[k] = under[parent[k]]
    label = under & (main * 2 > all_)
    label[story] = story != 1 or own[1] > 0  # a body is inside only for text of its own
    return label


@cache
def trained(pages: int = 1800, seed: int = 5) -> Trees:
    rng = random.Random(seed)
    parsed = [parse(training_page(rng)[0]) for _ in range(pages)]
    labels = np.concatenate([_labels(p) for p in parsed]).astype(float)  # this takes the marks away
    return Trees().fit(features(parsed)[0], labels)


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(Extractor(trees or trained()))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in cut_rows(batch, "html"):
                found = shared.value([h or "" for h in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
