"""Operator 9: main text of web pages by a tree-structured graphical model.

A page's block elements are nodes of a tree, each content or not. Node potentials are linear in tag, attribute and text
features, parent-child potentials in how labels follow one another; both are trained together, by the likelihood of whole
labelled pages, which :func:`labelled_pages` makes in many layouts. Sum-product messages go up the tree and down again,
and the text of every node whose marginal says content is kept.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|</[^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup; of these none is text either, and neither is what the others hold.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_NO_TEXT = frozenset("script style title head template noscript iframe object canvas audio video noembed noframes textarea select datalist annotation annotation-xml metadata desc".split())
_INLINE = frozenset(
    "a abbr acronym annotation annotation-xml b bdi bdo big br cite code data del desc dfn em font g i img ins kbd maction mark math menclose merror metadata mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none path q rb rp rt ruby s samp semantics small span strike strong sub sup svg text time tspan tt u var wbr".split()
)
#: What may stand in a head; anything else ends one that was left open.
_IN_HEAD = frozenset("title meta link style script base noscript template".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}


class Page:
    """Block elements in page order: parent, tag, attributes, text and its parts inside links; ``parts`` are blocks of text."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.attrs = [-1], ["#root"], [""]
        self.parts: list[tuple[int, str]] = []  # (node, text of a block), in page order
        self.links = [0]
        self._buffer: list[str] = []
        stack = [("#root", 0)]  # (tag, node): inline elements carry the node around them
        where: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag
        blocks = [0]  # places of all that aren't inline
        hidden = links = at = 0
        node = 0

        def last(tags) -> int:
            """Place of the innermost open element of one of the tags; 0 if there is none."""
            return max((where[t][-1] for t in tags if where.get(t)), default=0)

        def flush() -> None:
            if self._buffer:
                text = " ".join(html.unescape("".join(self._buffer)).split())
                self._buffer.clear()
                if text:
                    self.parts.append((node, text))

        def open_(tag: str, of: int) -> None:
            where.setdefault(tag, []).append(len(stack))
            if tag not in _INLINE:
                blocks.append(len(stack))
            stack.append((tag, of))

        def close(k: int) -> None:
            nonlocal hidden, links, node
            while len(stack) > k:
                tag, _ = stack.pop()
                where[tag].pop()
                hidden -= tag in _NO_TEXT
                links -= tag == "a"
                if tag not in _INLINE:
                    blocks.pop()
                    flush()
            node = stack[-1][1]

        def add(text: str) -> None:
            if text and not hidden:
                self._buffer.append(text)
                if links:
                    self.links[node] += len(text.strip())

        size = len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if not source[m.start() : m.end()].endswith(">"):
                break  # the page ends within a tag
            if m[1]:
                k = last((tag,))
                if k and not (tag in _INLINE and blocks[-1] > k):
                    close(k)
                elif tag == "br":
                    add(" ")
                continue
            if where.get("head") and tag not in _IN_HEAD and tag not in ("head", "html"):
                close(where["head"][-1])
            if tag in _CLOSES_P:
                k = last(("p",))
                if k > last(("table", "td", "th", "button", "caption")):
                    close(k)
            if tag in _ENDED_BY:
                ends, within = _ENDED_BY[tag]
                k = last(ends)
                if k > last(within):
                    while stack[k - 1][0] in ends and stack[k - 1][0] not in within and k > 1:
                        k -= 1
                    close(k)
            if tag in _VOID:
                if tag == "br":
                    add(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in _INLINE:
                open_(tag, node)
                links += tag == "a"
                hidden += tag in _NO_TEXT
                continue
            flush()
            self.parent.append(node)
            self.tag.append(tag)
            self.attrs.append(m[3] or "")
            self.links.append(0)
            node = len(self.parent) - 1
            open_(tag, node)
            hidden += tag in _NO_TEXT
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                add(source[at : end.start() if end else size])
                at = end.end() if end else size
                close(len(stack) - 1)
        flush()
        self.words = [0] * len(self.parent)
        self.chars = [0] * len(self.parent)
        self.stops = [0] * len(self.parent)
        for k, text in self.parts:
            self.words[k] += text.count(" ") + 1
            self.chars[k] += len(text)
            self.stops[k] += sum(map(text.count, ".,;?!"))


_TAGS = [
    {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "label", "input", "legend", "output"}, {"dialog"}, {"article"}, {"main"}, {"section"},
    {"p", "blockquote", "pre", "figcaption"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"div", "center"}, {"body", "html", "#root"},
]
_NAMES = [
    r"\b(?:nav|navbar|navigation|menu|topnav|breadcrumbs?|pagination|pager|tabs|toc)\b",
    r"\b(?:header|masthead|topbar|site-?header|page-?header|logo|branding|site-?title)\b",
    r"\b(?:footer|colophon|copyright|legal|site-?footer|page-?footer|bottom)\b",
    r"\b(?:sidebar|side|aside|rail|related|widgets?|recommended|popular|trending|more|tags?|also|teasers?)\b",
    r"\b(?:ads?|adverts?|advertisements?|advertising|promos?|promotions?|sponsor(?:ed|s)?|banner|sponsored-?content|ad-?\w+|adsbygoogle|dfp)\b",
    r"\b(?:cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|disclaimer|newsletter|subscribe|subscription|toast|paywall|warning|announcement|privacy)\b",
    r"\b(?:comments?|comment-?\w+|replies|reply|discussion|disqus|responses?|reader-?comments?|feedback|reviews?)\b",
    r"\b(?:form|login|signin|signup|search|search-?\w+|share|sharing|social|buttons?|toolbar|rating|poll|survey|contact)\b",
    r"\b(?:article|post|entry|story|content|main|body|text|prose|article-?\w+|post-?\w+|entry-?\w+|main-?content|story-?\w+|hentry|copy|paragraph)\b",
    r"\b(?:author|byline|meta|date|published|timestamp)\b",
]
_NAMED = [re.compile(x, re.IGNORECASE) for x in _NAMES]
_GROUP = {t: i for i, ts in enumerate(_TAGS) for t in ts}
#: A block of an otherwise empty article is left out below this marginal.
UNLIKELY = 0.02
N_FEATURES = len(_TAGS) + 1 + len(_NAMED) + 9


@lru_cache(50_000)
def _attribute_features(attrs: str) -> tuple[int, ...]:
    """Which name patterns the class, id and role attributes match; camel case and underscores count as word borders."""
    if not attrs.strip():
        return ()
    values = [v.strip("\"'") for k, v in _ATTRIBUTE.findall(attrs) if k.lower() in ("class", "id", "role", "itemprop", "aria-label", "data-type", "data-role")]
    text = re.sub(r"(?<=[a-z])(?=[A-Z])|_", "-", " ".join(values))
    return tuple(i for i, p in enumerate(_NAMED) if p.search(text))


def node_features(page: Page) -> np.ndarray:
    n = len(page.parent)
    x = np.zeros((n, N_FEATURES))
    names = len(_TAGS) + 1
    rest = names + len(_NAMED)
    for i in range(n):
        x[i, _GROUP.get(page.tag[i], len(_TAGS))] = 1
        for k in _attribute_features(page.attrs[i]):
            x[i, names + k] = 1
    words, chars, stops, links = (np.array(v, float) for v in (page.words, page.chars, page.stops, page.links))
    linked = links / np.maximum(chars, 1)
    x[:, rest] = 1
    x[:, rest + 1] = words == 0
    x[:, rest + 2] = (words > 0) & (words < 5)
    x[:, rest + 3] = (words >= 5) & (words < 15)
    x[:, rest + 4] = words >= 40
    x[:, rest + 5] = (linked > 0.3) & (words > 0)
    x[:, rest + 6] = (linked > 0.8) & (words > 0)
    x[:, rest + 7] = np.minimum(1, stops / np.maximum(words, 1))
    x[:, rest + 8] = (linked == 0) & (words > 0)
    return x


class Model:
    """Weights of the node potentials, and the parent-child potentials (parent's label, child's label)."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray) -> None:
        self.weights, self.pairs = weights, pairs

    def marginals(self, page: Page) -> np.ndarray:
        """P(content) of each node, exactly, by messages to the root and back."""
        z = np.clip(node_features(page) @ self.weights, -30, 30)
        (p00, p01), (p10, p11) = np.exp(self.pairs).tolist()
        parent = page.parent
        n = len(parent)
        up = np.exp(z).tolist()  # odds of content from the node and all below it
        sent = [1.0] * n
        for i in range(n - 1, 0, -1):  # a child stands after its parent
            o = up[i]
            sent[i] = (p10 + p11 * o) / (p00 + p01 * o)
            k = parent[i]
            up[k] = min(max(up[k] * sent[i], 1e-250), 1e250)
        belief = up[:]
        for i in range(1, n):
            o = belief[parent[i]] / sent[i]  # of the parent, without what this node told it
            belief[i] = min(max(up[i] * (p01 + p11 * o) / (p00 + p10 * o), 1e-250), 1e250)
        b = np.array(belief)
        return b / (1 + b)


class _Trees:
    """Many trees at once, level by level: the expected features that training needs."""

    def __init__(self, parents: list[list[int]]) -> None:
        starts = np.append(0, np.cumsum([len(p) for p in parents]))
        self.parent = np.concatenate([np.array(p) + s for p, s in zip(parents, starts)])
        root = starts[:-1]
        depth = np.zeros(len(self.parent), int)
        self.child = np.ones(len(self.parent), bool)
        self.child[root] = False
        for i in np.flatnonzero(self.child).tolist():  # parents come first
            depth[i] = depth[self.parent[i]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]

    def expected(self, z: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(content) of each node, expected counts of label pairs over all edges, and the log of the partition function."""
        up0, up1 = np.zeros(len(z)), z.copy()
        m0, m1 = np.zeros(len(z)), np.zeros(len(z))
        for rows in reversed(self.levels):
            m0[rows] = np.logaddexp(pairs[0, 0] + up0[rows], pairs[0, 1] + up1[rows])
            m1[rows] = np.logaddexp(pairs[1, 0] + up0[rows], pairs[1, 1] + up1[rows])
            np.add.at(up0, self.parent[rows], m0[rows])
            np.add.at(up1, self.parent[rows], m1[rows])
        roots = ~self.child
        whole = float(np.logaddexp(up0[roots], up1[roots]).sum())
        b0, b1 = up0.copy(), up1.copy()
        counts = np.zeros((2, 2))
        for rows in self.levels:
            k = self.parent[rows]
            r0, r1 = b0[k] - m0[rows], b1[k] - m1[rows]
            joint = np.stack([r0 + pairs[0, 0] + up0[rows], r0 + pairs[0, 1] + up1[rows], r1 + pairs[1, 0] + up0[rows], r1 + pairs[1, 1] + up1[rows]])
            top = joint.max(axis=0)
            joint = np.exp(joint - top)
            total = joint.sum(axis=0)
            counts += (joint / total).sum(axis=1).reshape(2, 2)
            b0[rows] = np.log(joint[0] + joint[2]) + top
            b1[rows] = np.log(joint[1] + joint[3]) + top
        return 1 / (1 + np.exp(np.clip(b0 - b1, -700, 700))), counts, whole


def fit(xs: list[np.ndarray], ys: list[list[int]], parents: list[list[int]], ridge: float = 1.0, rounds: int = 150) -> Model:
    """Weights and pair potentials of greatest joint likelihood, with a ridge, by preconditioned ascent."""
    trees = _Trees(parents)
    x, y = np.vstack(xs), np.concatenate(ys).astype(float)
    up = trees.parent[trees.child]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[up].astype(int), y[trees.child].astype(int)), 1)
    w, pairs = np.zeros(x.shape[1]), np.zeros((2, 2))
    step = np.linalg.inv(x.T @ x / 4 + ridge * np.eye(len(w)))
    gain, last = 1.0, -np.inf
    best = (w, pairs)
    for _ in range(rounds):
        p, counts, whole = trees.expected(x @ w, pairs)
        value = float(y @ (x @ w) + (seen * pairs).sum()) - whole - ridge / 2 * float(w @ w + (pairs**2).sum())
        if value < last:
            gain /= 2
            w, pairs = best
            if gain < 1e-3:
                break
        else:
            done = value - last < 1e-3
            best, last = (w, pairs), value
            if done:
                break
            towards = (x.T @ (y - p) - ridge * w, seen - counts - ridge * pairs)
            gain *= 1.2
        w = best[0] + gain * step @ towards[0]
        pairs = best[1] + gain * towards[1] / (len(y) / 8 + ridge)
    return Model(np.round(best[0], 5), np.round(best[1], 5))


def extract(source: str | None, model: Model) -> str:
    """Main text of a page: its content blocks, one a line; null and empty pages have none.

    Where no block is likely content, those of an article or main element are taken that aren't very unlikely.
    """
    if not source:
        return ""
    page = Page(source)
    if not page.parts:
        return ""
    belief = model.marginals(page)
    keep = belief >= 0.5
    if not any(keep[k] for k, _ in page.parts):
        keep = _articles(page) & (belief >= UNLIKELY)
    return "\n".join(text for k, text in page.parts if keep[k])


def _articles(page: Page) -> np.ndarray:
    """Nodes in an article or main element, and in none, further in, that by its tag is no text of it."""
    inside = np.zeros(len(page.parent), bool)
    for i, tag in enumerate(page.tag):
        inside[i] = tag in ("article", "main") or i > 0 and inside[page.parent[i]] and tag not in ("nav", "menu", "aside", "footer", "form", "button", "dialog", "fieldset", "label")
    return inside


def labelled_pages(n: int, seed: int = 5) -> list[str]:
    """Pages of many layouts, where elements carry ``data-y`` (1: content): the training corpus."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]

    def words(lo: int, hi: int, stop: str = ".") -> str:
        k = r.randint(lo, hi)
        return " ".join(r.choice(vocabulary) + (r.choice(",.") if r.random() < 0.12 else "") for _ in range(k)).capitalize() + stop

    def e(tag: str, y: int, inner: str, **attrs: str) -> str:
        extra = "".join(f' {k.rstrip("_")}="{v}"' for k, v in attrs.items() if v)
        return f'<{tag} data-y="{y}"{extra}>{inner}</{tag}>'

    def link(lo: int = 1, hi: int = 4) -> str:
        return f'<a href="/{r.randint(1, 99)}">{words(lo, hi, "")}</a>'

    def name(*options: str) -> dict[str, str]:
        return {r.choice(("class_", "class_", "id_")): r.choice(options)}

    def menu() -> str:
        items = "".join(e("li", 0, link()) for _ in range(r.randint(2, 8)))
        inner = r.choice((e("ul", 0, items), " | ".join(link() for _ in range(5))))
        return e("nav", 0, inner) if r.random() < 0.5 else e("div", 0, inner, **name("nav", "menu", "navbar", "main-menu", "breadcrumb", "topnav", "pagination"))

    def side() -> str:
        inner = e("h3", 0, words(1, 3, "")) + r.choice((e("ul", 0, "".join(e("li", 0, link(2, 7)) for _ in range(4))), e("p", 0, words(5, 40))))
        return e("aside", 0, inner, **r.choice(({}, name("sidebar")))) if r.random() < 0.5 else e("div", 0, inner, **name("sidebar", "related", "widget", "right-rail", "popular", "related-posts"))

    def advert() -> str:
        inner = r.choice((words(3, 30), e("p", 0, words(3, 30)), e("p", 0, words(3, 20) + link())))
        return e(r.choice(("div", "div", "section", "aside")), 0, inner, **name("ad", "ads", "advert", "ad-banner", "promo", "sponsored", "advertisement", "ad-slot", "sponsor"))

    def notice() -> str:
        inner = r.choice((e("p", 0, words(4, 30)), words(4, 30))) + r.choice(("", e("button", 0, words(1, 2, ""))))
        return e(r.choice(("div", "div", "section", "dialog", "aside")), 0, inner, **name("cookie-banner", "notice", "cookie-consent", "alert", "newsletter", "gdpr", "popup", "consent", "cookie-notice", "subscribe"))

    def form() -> str:
        inner = e("label", 0, words(1, 5, "")) + '<input type="text">' + e("button", 0, words(1, 2, "")) + r.choice(("", e("p", 0, words(3, 20))))
        return e("form", 0, inner, **r.choice(({}, name("search", "login", "signup", "contact-form"))))

    def comments() -> str:
        one = lambda: e(r.choice(("div", "li", "article")), 0, e("p", 0, words(3, 50)) + r.choice(("", e("span", 0, words(1, 2, "")))), **r.choice((name("comment", "comment-body", "reply"), {})))
        return e(r.choice(("section", "div", "ol", "ul")), 0, r.choice(("", e("h2", 0, words(1, 3, "")))) + "".join(one() for _ in range(r.randint(1, 4))), **name("comments", "comment-list", "discussion", "responses", "reader-comments"))

    def header() -> str:
        inner = r.choice((e("h1", 0, link()), e("div", 0, words(1, 4, ""), **name("logo", "site-title")), e("p", 0, words(2, 10)))) + (menu() if r.random() < 0.5 else "")
        return e("header", 0, inner) if r.random() < 0.6 else e("div", 0, inner, **name("header", "masthead", "site-header", "topbar"))

    def footer() -> str:
        inner = r.choice((f"&copy; {words(2, 20)}", e("p", 0, "&copy; " + words(2, 20)), e("div", 0, words(2, 15) + link())))
        return e("footer", 0, inner) if r.random() < 0.6 else e("div", 0, inner, **name("footer", "site-footer", "copyright", "page-footer"))

    def article() -> str:
        blocks = [e("h1", 1, words(2, 10, ""))] if r.random() < 0.8 else []
        if r.random() < 0.2:
            blocks = [e("header", 1, blocks[0])] if blocks else []
        for _ in range(r.choice((1, 2, 2, 3, 5, 8, 12))):
            if r.random() < 0.15:  # names that say little: what they name is text of the article all the same
                named = name("more-info", "related-work", "side-note", "tag-line", "alert-box", "header-image", "footer-notes", "contact-us", "read-more", "also-known", "popular-science", "social-history", "media-body", "row")
                blocks.append(
                    r.choice(
                        (
                            lambda: e("div", 1, "".join(e("p", 1, words(2, 60)) for _ in range(r.randint(1, 8))), **named), lambda: e("section", 1, e("h2", 1, words(1, 5, "")) + "".join(e("p", 1, words(2, 60)) for _ in range(r.randint(1, 8))), **named),
                            lambda: e("p", 1, words(2, 60), **named), lambda: e("div", 1, words(2, 60), **named),
                        )
                    )()
                )
            blocks.append(
                r.choices(
                    (
                        lambda: e("p", 1, words(1, 120)), lambda: e("p", 1, words(1, 5, r.choice((".", "", "|")))), lambda: e("p", 1, words(1, 60, "") + " " + link(1, 9) + r.choice(("", words(2, 20)))), lambda: e("h2", 1, words(1, 6, "")),
                        lambda: e("ul", 1, "".join(e("li", 1, words(2, 20)) for _ in range(3))), lambda: e("blockquote", 1, e("p", 1, words(4, 40))),
                        lambda: e("table", 1, e("tr", 1, e("td", 1, words(1, 5, "")) + e("td", 1, words(1, 5, "")))), lambda: e("div", 1, words(3, 60)), lambda: e("section", 1, e("h2", 1, words(1, 5, "")) + e("p", 1, words(3, 60))),
                        lambda: e("figure", 1, e("figcaption", 1, words(2, 12))), lambda: e("pre", 1, words(3, 20)), lambda: e("p", 1, words(1, 6, "") + " " + link(4, 12)), lambda: e("p", 1, link(2, 9)),
                    ),
                    (8, 6, 2, 2, 1, 1, 0.5, 1, 1, 0.5, 0.3, 2, 0.6),
                )[0]()
            )
            if r.random() < 0.12:
                blocks.append(r.choice((advert, side, form, notice, comments))())
        inner = "".join(blocks)
        shape = r.random()
        if shape < 0.45:
            return e("article", 1, inner, **r.choice(({}, name("post", "story", "entry"))))
        if shape < 0.6:
            return e("main", 1, inner)
        if shape < 0.7:
            return e("main", 1, e("article", 1, inner))
        return e("div", 1, inner, **name("content", "post", "article", "entry-content", "main", "article-body", "story", "main-content", "post-body"))

    pages = []
    for _ in range(n):
        before = [x() for x in (notice, header, menu, advert, form) if r.random() < 0.45]
        after = [x() for x in (comments, side, advert, notice, form, menu) if r.random() < 0.3] + ([footer()] if r.random() < 0.8 else [])
        r.shuffle(before)
        middle = article()
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):  # elements around the article that say nothing
            around = [middle] + [x() for x in (side, menu, advert) if r.random() < 0.15]
            r.shuffle(around)
            middle = e(r.choice(("div", "div", "div", "section")), 1, "".join(around), **r.choice(({}, name("container", "wrapper", "row", "layout", "page", "primary", "inner", "outer", "site", "col-md-8", "wrap", "root", "app", "grid"))))
        inside = "".join([*before, middle, *after])
        if r.random() < 0.4:
            inside = e("div", 1, inside, **r.choice(({}, name("page", "wrapper", "container", "site", "root", "app", "outer"))))
        pages.append(f'<html data-y="1"><head><title>x</title></head>{e("body", 1, inside, **r.choice(({}, name("home", "single", "blog", "page-template", "js"))))}</html>')
    return pages


_LABEL = re.compile(r'data-y="(\d)"')


@lru_cache(2)
def trained(n: int = 300, seed: int = 5) -> Model:
    """The model, fitted on ``n`` labelled pages; the same wherever it is trained."""
    xs, ys, parents = [], [], []
    for source in labelled_pages(n, seed):
        page = Page(source)
        ys.append(labels_of(page))
        xs.append(node_features(page))
        parents.append(page.parent)
    return fit(xs, ys, parents)


def labels_of(page: Page) -> list[int]:
    """The labels that a training page carries, which are taken out of its attributes; unlabelled nodes have their parent's."""
    y = [1] * len(page.parent)
    for i in range(1, len(y)):
        m = _LABEL.search(page.attrs[i])
        y[i] = int(m[1]) if m else y[page.parent[i]]
    page.attrs = [_LABEL.sub("", a) for a in page.attrs]
    return y


def extract_text(pages: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in ``into``.

    Character references are decoded, white space in a block becomes one space, blocks are joined by line feeds in page
    order. Null, empty and textless pages give an empty text; repeated rows each get theirs; a page that ends within a
    tag loses that tag; a column named as ``into`` is replaced, others stay; an empty table gives an empty table. The
    model is trained once on the driver from made pages and sent with the task (a few hundred bytes). No shuffle.
    """
    model = trained()

    @F.arrow_udf(StringType())
    def run(sources: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py(), model) for x in sources], pa.string())

    return pages.withColumn(into, run(F.col(html_column)))


def digest(pages: DataFrame) -> DataFrame:
    """The columns that query op9 returns."""
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
