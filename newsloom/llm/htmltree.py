"""Main text of web pages by a tree-structured graphical model over their DOM.

Every block element of a page is a binary variable: content or not.  Its own
features (tag, words of class and id, text length, link density, place) give a
node potential, and each parent and child share a potential by the tag families
of both.  Sum-product messages run upward and downward once, level by level over
a whole batch of pages, and give exact marginals; a text run is kept if its
block's marginal says content.

The weights are those of a conditional random field trained on labelled pages
with the same messages: the gradient is labels minus marginals.  The labelled
pages are ``TRAIN_PAGES`` documents drawn from templates in this module (a
bounded, documented sample; every page of the input is extracted whole).

Edge cases: a null or empty page gives an empty text; unclosed, misnested and
truncated markup is read as far as it goes; text outside of any element counts
for the page's root; repeated rows are repeated in the result; an empty table
gives an empty result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 1200
PAGES_AT_ONCE = 200

# Element names, fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button select option label legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math head object canvas video audio".split())
CLOSES_P = BLOCKS - frozenset("button select option label legend dialog body html td th tr tbody thead tfoot".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table div section article aside nav main body form".split())

# Words of class, id and role that features look at, fixed values.
WORDS = (
    "nav menu navbar breadcrumb breadcrumbs toc header masthead topbar logo banner footer bottom copyright colophon sidebar side rail widget aside complementary ad ads advert advertisement adsense sponsor sponsored promo "
    "promotion cookie consent notice alert message popup modal overlay gdpr comment comments respond reply discussion disqus share social follow related recommended more popular trending newsletter subscribe signup login search "
    "form contact tag tags meta byline author date pagination pager hidden article post entry content story main body text page maincontent articlebody container wrapper inner col row contentinfo navigation"
).split()
WORD_INDEX = {w: i for i, w in enumerate(WORDS)}
TAGS = sorted(BLOCKS)
TAG_INDEX = {t: i for i, t in enumerate(TAGS)}
FAMILY = {t: k for k, ts in enumerate(("p pre blockquote h1 h2 h3 h4 h5 h6 figure figcaption", "ul ol dl li dt dd menu", "table tbody thead tfoot tr td th", "nav aside footer header form fieldset button select option label legend dialog")) for t in ts.split()}
N_FAMILIES = 5
#: Parent and child share a potential by the tag families of both.
N_PAIRS = N_FAMILIES * N_FAMILIES

_AT = {"tag": 0}
_AT["word"] = _AT["tag"] + len(TAGS)
_AT["own"] = _AT["word"] + len(WORDS)
_AT["all"] = _AT["own"] + 6
_AT["links"] = _AT["all"] + 5
_AT["depth"] = _AT["links"] + 5
_AT["place"] = _AT["depth"] + 4
_AT["hidden"] = _AT["place"] + 4
_AT["control"] = _AT["hidden"] + 1
_AT["prose"] = _AT["control"] + 1
_AT["words of parent"] = _AT["prose"] + 5
N_FEATURES = _AT["words of parent"] + len(WORDS)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Block elements of a page: parent, depth, tag, feature words; and its text runs in page order."""

    def __init__(self, source: str) -> None:
        self.parent, self.depth, self.tag, self.words, self.hidden, self.control = [-1], [0], ["html"], [()], [False], [False]
        self.marks: list[str] = [""]  # the label attribute of training pages
        self.runs: list[tuple[int, str, int]] = []  # block, text, characters in links
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block
        links, parts, linked, owner = 0, [], 0, 0

        def flush() -> None:
            nonlocal parts, linked
            text = " ".join("".join(parts).split())
            if text:
                self.runs.append((owner, text, min(linked, len(text))))
            parts, linked = [], 0

        def say(piece: str) -> None:
            nonlocal linked
            if piece:
                piece = html.unescape(piece) if "&" in piece else piece
                parts.append(piece)
                linked += len(piece.strip()) if links else 0

        def close_to(depth: int) -> None:
            nonlocal owner, links
            for name, _ in stack[depth:]:
                links -= name == "a"
            if any(name in BLOCKS for name, _ in stack[depth:]):
                flush()
            del stack[depth:]
            owner = stack[-1][1]

        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if not m:
                say(source[at:])
                break
            say(source[at : m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        close_to(k)
                        break
                continue
            if name in RAW:
                if name == "head":
                    continue
                if not m[3].endswith("/") or name in ("script", "style", "title", "textarea"):
                    tail = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                    at = tail.start() if tail else (end if name in ("script", "style") else at)
                continue
            if name in VOID:
                if name in ("br", "hr", "wbr") or name == "input":
                    parts.append(" " if name != "wbr" else "")
                if name == "input":
                    self.control[owner] = True
                if name == "hr":
                    flush()
                continue
            if name in ("html", "body") and len(stack) > 1 and any(n == name for n, _ in stack):
                continue
            if name == "html":
                continue
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close_to(k)
                        break
                    if stack[k][0] in SCOPES:
                        break
            if name in SAME_LEVEL:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in SAME_LEVEL[name]:
                        close_to(k)
                        if name not in ("tr", "tbody"):
                            break
                    elif stack[k][0] in SCOPES:
                        break
            if name not in BLOCKS:
                stack.append((name, owner))
                links += name == "a"
                continue
            flush()
            words, hidden, mark = set(), False, ""
            if m[3].strip():
                for a in _ATTRIBUTE.finditer(m[3]):
                    key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if key in ("class", "id", "role"):
                        words.update(w.lower() for w in _WORD.findall(value))
                    elif key == "hidden" or key == "aria-hidden" and value == "true" or "display:none" in value.replace(" ", "").lower():
                        hidden = True
                if "data-gold" in m[3]:
                    mark = "1" if 'data-gold="1"' in m[3] else "0"
            self.parent.append(owner)
            self.depth.append(self.depth[owner] + 1)
            self.tag.append(name)
            self.words.append(tuple(WORD_INDEX[w] for w in words if w in WORD_INDEX))
            self.hidden.append(hidden or self.hidden[owner])
            self.control.append(name in ("button", "select", "option"))
            self.marks.append(mark)
            owner = len(self.parent) - 1
            stack.append((name, owner))
        close_to(1)
        flush()


class Forest:
    """Pages laid end to end as arrays for message passing."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        begins = np.cumsum(sizes) - sizes
        self.begins = begins
        self.depth = np.concatenate([np.array(p.depth) for p in pages])
        parent = np.concatenate([np.array(p.parent) + (b if b else 0) for p, b in zip(pages, begins, strict=True)])
        root = np.zeros(len(parent), bool)
        root[begins] = True
        self.parent = np.where(root, -1, parent)
        n = len(parent)
        own, linked = np.zeros(n), np.zeros(n)
        runs = [(b + k, len(t), x) for p, b in zip(pages, begins, strict=True) for k, t, x in p.runs]
        if runs:
            at, chars, links = (np.array(x) for x in zip(*runs, strict=True))
            np.add.at(own, at, chars)
            np.add.at(linked, at, links)
        whole, whole_links = own.copy(), linked.copy()
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max()) + 1)]
        for level in self.levels[:0:-1]:
            np.add.at(whole, self.parent[level], whole[level])
            np.add.at(whole_links, self.parent[level], whole_links[level])
        total = np.repeat(whole[begins], sizes)
        before = np.cumsum(own) - own
        before -= np.repeat(before[begins], sizes)
        bins = lambda x, edges: np.searchsorted(np.array(edges), x, side="right")
        tag = np.array([TAG_INDEX[t] for p in pages for t in p.tag])
        self.family = np.array([FAMILY.get(t, N_FAMILIES - 1) for p in pages for t in p.tag])
        paragraphs = np.zeros(n)
        np.add.at(paragraphs, self.parent[(tag == TAG_INDEX["p"]) & ~root], 1)
        self.pair = np.where(root, 0, self.family[self.parent] * N_FAMILIES + self.family)
        share = np.where(whole > 0, whole_links / np.maximum(whole, 1), 0)
        columns = [
            _AT["tag"] + tag,
            _AT["own"] + bins(own, [1, 25, 60, 150, 400]),
            _AT["all"] + bins(whole, [1, 60, 250, 1000]),
            _AT["links"] + np.where(whole > 0, bins(share, [0.01, 0.25, 0.6]), 4),
            _AT["depth"] + bins(self.depth, [2, 3, 5]),
            _AT["prose"] + bins(paragraphs, [1, 2, 4, 8]),
            _AT["place"] + bins(np.where(total > 0, before / np.maximum(total, 1), 0), [0.05, 0.5, 0.9]),
        ]
        rows = [np.arange(n)] * len(columns)
        for at, flags in (("hidden", [x for p in pages for x in p.hidden]), ("control", [x for p in pages for x in p.control])):
            some = np.flatnonzero(np.array(flags))
            rows.append(some)
            columns.append(np.full(len(some), _AT[at]))
        words = [(b + k, w) for p, b in zip(pages, begins, strict=True) for k, ws in enumerate(p.words) for w in ws]
        if words:
            rows.append(np.array([k for k, _ in words]))
            columns.append(_AT["word"] + np.array([w for _, w in words]))
        above = [(b + k, w) for p, b in zip(pages, begins, strict=True) for k, up in enumerate(p.parent) if up >= 0 for w in p.words[up]]
        if above:
            rows.append(np.array([k for k, _ in above]))
            columns.append(_AT["words of parent"] + np.array([w for _, w in above]))
        self.row, self.column = np.concatenate(rows), np.concatenate(columns)

    def messages(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of content, and of (parent, child) label pairs; pairs: log potentials (families, parent, child)."""
        n = len(self.depth)
        belief = np.zeros((n, 2))
        belief[:, 1] = np.bincount(self.row, weights[self.column], n)
        up = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            joint = belief[level][:, None, :] + pairs[self.pair[level]]
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(belief, self.parent[level], up[level])
        both = np.full((n, 2, 2), -np.inf)
        for level in self.levels[1:]:
            top = belief[self.parent[level]] - up[level]
            joint = top[:, :, None] + belief[level][:, None, :] + pairs[self.pair[level]]
            both[level] = joint
            belief[level] += np.logaddexp((top[:, 0, None] + pairs[self.pair[level]][:, 0]), (top[:, 1, None] + pairs[self.pair[level]][:, 1]))
        marginal = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        both -= both.max(axis=(1, 2), keepdims=True, initial=-1e300)
        both = np.exp(both)
        return marginal, both / np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-300)


def train(pages: list[Page], rounds: int = 250, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair potentials of the conditional random field, by Adam on the exact gradient."""
    forest = Forest(pages)
    gold = np.array([x == "1" for p in pages for x in p.marks], float)
    inner = forest.parent >= 0
    paired = np.zeros((N_PAIRS, 2, 2))
    np.add.at(paired, (forest.pair[inner], gold[forest.parent[inner]].astype(int), gold[inner].astype(int)), 1)
    x = np.zeros(N_FEATURES + 4 * N_PAIRS)
    m, v = np.zeros_like(x), np.zeros_like(x)
    n = len(gold)
    for t in range(1, rounds + 1):
        marginal, both = forest.messages(x[:N_FEATURES], x[N_FEATURES:].reshape(N_PAIRS, 2, 2))
        expected = np.zeros((N_PAIRS, 2, 2))
        np.add.at(expected, forest.pair[inner], both[inner])
        grad = np.concatenate([np.bincount(forest.column, (gold - marginal)[forest.row], N_FEATURES), (paired - expected).ravel()]) / n - decay * x
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:N_FEATURES], x[N_FEATURES:].reshape(N_PAIRS, 2, 2)


def extract(sources: list[str], weights: np.ndarray, pairs: np.ndarray) -> list[str]:
    """Main text of each page."""
    out: list[str] = []
    for a in range(0, len(sources), PAGES_AT_ONCE):
        pages = [Page(s) for s in sources[a : a + PAGES_AT_ONCE]]
        forest = Forest(pages)
        marginal, _ = forest.messages(weights, pairs)
        keep = marginal > 0.5
        out += ["\n\n".join(t for k, t, _ in p.runs if keep[b + k]) for p, b in zip(pages, forest.begins.tolist(), strict=True)]
    return out


# Labelled pages --------------------------------------------------------------------------------------------------


class _Writer:
    """Draws labelled pages from templates; data-gold marks every element as content (1) or not (0)."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.short = 0.1

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return (" ".join(out)).capitalize()

    def prose(self, low: int = 1, high: int = 5) -> str:
        return " ".join(self.words(5, 25) + "." for _ in range(self.r.randint(low, high)))

    def el(self, tag: str, gold: int, inner: str, attrs: str = "") -> str:
        return f'<{tag}{" " + attrs if attrs else ""} data-gold="{gold}">{inner}</{tag}>'

    def name(self, *names: str) -> str:
        """class or id with one of the names, or none at all."""
        r = self.r
        if r.random() < 0.2:
            return ""
        value = r.choice(names)
        if r.random() < 0.3:
            value += r.choice(("-wrap", "-box", "_block", "-1", " clearfix", " row"))
        return f'{r.choice(("class", "class", "id"))}="{value}"'

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(low, high)}</a>'

    def links(self, gold: int = 0, low: int = 3, high: int = 9) -> str:
        return self.el(self.r.choice(("ul", "ol", "ul")), gold, "".join(self.el("li", gold, self.link()) for _ in range(self.r.randint(low, high))))

    def menu(self) -> str:
        return self.el("nav", 0, self.links()) if self.r.random() < 0.7 else self.el("div", 0, self.links(), self.name("menu", "nav", "navbar", "breadcrumbs", "navigation"))

    def header(self) -> str:
        r = self.r
        inner = r.choice((self.el("div", 0, self.link(), self.name("logo", "masthead")), self.el("h1", 0, self.link()), self.el("p", 0, self.words(2, 6)))) + (self.menu() if r.random() < 0.5 else "")
        return self.el("header", 0, inner) if r.random() < 0.6 else self.el("div", 0, inner, self.name("header", "topbar", "banner", "masthead"))

    def footer(self) -> str:
        r = self.r
        inner = r.choice(("&copy; 2024 " + self.words(2, 8), self.links(), self.el("p", 0, self.words(4, 14) + ". " + self.link()), self.el("div", 0, self.prose(1, 2), self.name("copyright", "colophon")), "&copy; " + self.prose(1, 2)))
        return self.el("footer", 0, inner) if r.random() < 0.7 else self.el("div", 0, inner, self.name("footer", "bottom", "copyright", "contentinfo"))

    def advert(self) -> str:
        inner = self.r.choice((self.words(3, 9) + ".", self.prose(1, 3), self.link(2, 6), self.el("p", 0, self.prose(1, 2)), self.el("p", 0, self.words(3, 8) + " " + self.link(2, 4))))
        return self.el(self.r.choice(("div", "div", "aside", "section")), 0, inner, f'class="{self.r.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner", "promotion"))}"')

    def notice(self) -> str:
        inner = self.r.choice((self.prose(1, 2) + "<button data-gold=\"0\">OK</button>", self.el("p", 0, self.prose(1, 3)), self.words(4, 12) + " " + self.link()))
        return self.el(self.r.choice(("div", "div", "section", "aside")), 0, inner, f'{self.r.choice(("class", "id"))}="{self.r.choice(("cookie-notice", "cookie", "consent", "notice", "alert", "popup", "modal", "gdpr", "message", "cookie-banner"))}"')

    def form(self) -> str:
        inner = self.el("label", 0, self.words(1, 3)) + '<input name="x">' + self.el("button", 0, self.words(1, 2)) + (self.el("p", 0, self.prose(1, 2)) if self.r.random() < 0.4 else "")
        return self.el("form", 0, inner) if self.r.random() < 0.7 else self.el("div", 0, self.el("p", 0, self.prose(1, 1)) + self.el("form", 0, inner), self.name("newsletter", "subscribe", "signup", "login", "search", "contact"))

    def sidebar(self) -> str:
        inner = self.el(self.r.choice(("h2", "h3", "h4")), 0, self.words(1, 4)) + self.r.choice((self.links(), self.el("p", 0, self.prose(1, 3)), self.links() + self.el("p", 0, self.prose(1, 2))))
        return self.el("aside", 0, inner) if self.r.random() < 0.6 else self.el("div", 0, inner, f'class="{self.r.choice(("sidebar", "widget", "rail", "related", "popular", "trending", "side", "recommended"))}"')

    def share(self) -> str:
        return self.el("div", 0, " ".join(self.link(1, 1) for _ in range(4)), f'class="{self.r.choice(("share", "social", "follow", "tags", "meta"))}"')

    def comments(self) -> str:
        one = lambda: self.r.choice((self.el("div", 0, self.el("p", 0, self.words(1, 2)) + self.el("p", 0, self.prose(1, 4)), 'class="comment"'), self.el("li", 0, self.el("p", 0, self.prose(1, 3))), self.el("div", 0, self.prose(1, 3), 'class="comment-body"')))
        inner = self.el("h3", 0, self.words(1, 3)) + "".join(one() for _ in range(self.r.randint(1, 6)))
        return self.el(self.r.choice(("section", "div", "div", "ol")), 0, inner, f'{self.r.choice(("class", "id"))}="{self.r.choice(("comments", "comment-list", "respond", "discussion", "disqus", "comments-area"))}"')

    def paragraph(self) -> str:
        text = self.prose(1, 6)
        if self.r.random() < 0.25:
            text = f"<b>{text}</b><br>"
        if self.r.random() < 0.25:
            text += " " + self.link(1, 4) + " " + self.prose(1, 2)
        if self.r.random() < self.short:
            text = self.r.choice((self.words(1, 6), self.words(1, 8) + ".", self.words(1, 2) + "."))
        return self.el("p", 1, text)

    def body(self) -> str:
        r, out = self.r, []
        self.short = r.choice((0.05, 0.2, 0.5, 0.95))  # pages differ in how many short paragraphs they have
        for _ in range(r.choice((0, 1, 1, 2, 3, 4, 6, 9, 14, 25, 50))):
            x = r.random()
            if x < 0.7:
                out.append(self.paragraph())
            elif x < 0.78:
                out.append(self.el(r.choice(("h2", "h3")), 1, self.words(1, 7)))
            elif x < 0.85:
                out.append(self.el(r.choice(("ul", "ol")), 1, "".join(self.el("li", 1, r.choice((self.words(1, 9), self.prose(1, 2)))) for _ in range(r.randint(2, 5)))))
            elif x < 0.9:
                out.append(self.el("blockquote", 1, r.choice((self.prose(1, 2), self.el("p", 1, self.prose(1, 2))))))
            elif x < 0.93:
                out.append(self.el("table", 1, self.el("tbody", 1, "".join(self.el("tr", 1, self.el("td", 1, self.words(1, 3)) * 2) for _ in range(3)))))
            elif x < 0.95:
                out.append(self.el("pre", 1, self.words(3, 20)))
            elif x < 0.97:
                out.append(self.el("div", 1, self.prose(1, 4)))
            else:
                out.append(r.choice((self.advert, self.share, self.sidebar, self.form, self.notice))())
        return "".join(out)

    def article(self) -> str:
        r = self.r
        title = self.el(r.choice(("h1", "h1", "h1", "h2")), 1, self.words(2, 14) + r.choice(("", ".")))
        if r.random() < 0.15:
            title = self.el("header", 1, title)
        body = self.body()
        if not body or r.random() < 0.1:
            body += self.paragraph()
        if r.random() < 0.35:
            body = self.el("div", 1, body, self.name("content", "entry-content", "post-body", "article-body", "text", "story"))
        tail = "".join(f() for f in (self.share, self.comments, self.sidebar, self.form) if r.random() < 0.15)
        if r.random() < 0.65:
            return self.el("article", 1, title + body + tail, self.name("post", "article", "entry", "story") if r.random() < 0.5 else "")
        return self.el(r.choice(("div", "div", "main", "section")), 1, title + body + tail, f'{r.choice(("class", "id"))}="{r.choice(("content", "post", "article", "main", "entry", "story", "main-content", "page-content", "articleBody"))}"')

    def page(self) -> str:
        r = self.r
        some = lambda *fs, p: "".join(f() for f in fs if r.random() < p)
        top = some(self.notice, p=0.25) + some(self.header, p=0.45) + some(self.menu, p=0.7) + some(self.advert, p=0.5) + some(self.form, p=0.15) + some(self.share, p=0.1)
        middle = some(self.sidebar, p=0.2) + self.article() + some(self.comments, self.sidebar, self.form, self.advert, self.share, p=0.3)
        if r.random() < 0.3:
            middle = self.el(r.choice(("main", "div", "section")), 1, middle, self.name("main", "container", "wrapper", "page", "row", "content"))
        bottom = some(self.footer, p=0.85) + some(self.notice, p=0.15)
        return f'<html><head><title>{self.words(2, 8)}</title></head><body data-gold="1">{top}{middle}{bottom}</body></html>'


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 11) -> list[Page]:
    writer = _Writer(seed)
    return [Page(writer.page()) for _ in range(n)]


def main_text(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages; pages are handled where they lie, without a shuffle."""
    weights, pairs = train(labelled_pages()) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract([x or "" for x in batch.column(2).to_pylist()], weights, pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
