"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a variable: frame (it holds the content somewhere
below), content, or the rest.  Parent and child are tied by a potential for the
child's kind (inline markup, a part of a list or table, a text block, a box;
with or without class, id and role words), and each element has potentials
within its kind from its tag, its words, the length of its text, its sentence
ends, and the share of it in links.  All of them are counted from labelled
pages.  On a tree, sum-product message passing is exact: one pass up and one
pass down give each element's content marginal.  Text whose nearest element is
content is kept.

The labelled pages are made here from a seed, in many layouts: with semantic
tags, with telling class names or with bare divs; with menus, adverts,
notices, forms, sidebars, footers and reader comments around and inside the
article.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by a line end, empty ones
left out.

Defined cases: a null or empty page has an empty text; broken markup (unclosed
or crossing tags, cut pages) is read as far as it goes; depth and length are
not limited: there is no recursion, and reading takes time in proportion to a
page's length whatever it holds; equal pages have equal texts.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkgram.llm.common import bounded_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that a start tag of their group ends, by group; each is looked for up to the scopes below.
_GROUPS = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_SCOPES = {
    0: frozenset("html body article section div td th li blockquote main aside header footer nav form table".split()),
    1: frozenset("ul ol menu".split()),
    2: frozenset(["dl"]),
    3: frozenset(["table"]),
    4: frozenset(["tr", "table"]),
    5: frozenset(["select"]),
}
_RESETS = {tag: [g for g, scope in _SCOPES.items() if tag in scope] for tag in frozenset().union(*_SCOPES.values())}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE) for tag in RAW}


@dataclass
class Page:
    """Elements in document order (a parent before its children), and the text."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    words: list[list[str]] = field(default_factory=lambda: [[]])
    marks: list[str | None] = field(default_factory=lambda: [None])
    #: (element, text) in page order; element -1 ends a block.
    runs: list[tuple[int, str]] = field(default_factory=list)


class _Stack:
    """Open elements, how many there are of each tag, and for each group of
    ``_GROUPS`` the depth of its nearest open element in scope (0: none)."""

    def __init__(self, tags: list[str]):
        self.tags, self.nodes = tags, [0]
        self.nearest: list[tuple[int, ...]] = [(0,) * len(_SCOPES)]
        self.count: Counter[str] = Counter()

    def push(self, node: int, tag: str) -> None:
        nearest = self.nearest[-1]
        group = _GROUPS.get(tag)
        if group is not None or tag in _RESETS:
            changed = list(nearest)
            for g in _RESETS.get(tag, ()):
                changed[g] = 0
            if group is not None:
                changed[group] = len(self.nodes)
            nearest = tuple(changed)
        self.nodes.append(node)
        self.nearest.append(nearest)
        self.count[tag] += 1

    def cut(self, depth: int) -> None:
        for node in self.nodes[depth:]:
            self.count[self.tags[node]] -= 1
        del self.nodes[depth:], self.nearest[depth:]

    def close(self, tag: str) -> None:
        """Ends the nearest open element of a tag and what it holds, if there is one."""
        if self.count[tag]:
            depth = len(self.nodes) - 1
            while self.tags[self.nodes[depth]] != tag:
                depth -= 1
            self.cut(depth)

    def make_room(self, tag: str) -> None:
        """Ends what a start tag ends without an end tag."""
        nearest = self.nearest[-1]
        depth = nearest[0] if tag in CLOSES_P else nearest[_GROUPS[tag]] if tag in _GROUPS else 0
        if tag == "tr":
            depth = depth or nearest[_GROUPS["td"]]
        if depth:
            self.cut(depth)


def parse(source: str | None) -> Page:
    page, source = Page(), source or ""
    tags, runs = page.tags, page.runs
    stack = _Stack(tags)
    at, end = 0, len(source)
    last = source.rfind(">") + 1  # beyond it no tag ends

    def text(upto: int) -> None:
        if upto > at:
            runs.append((stack.nodes[-1], html.unescape(source[at:upto])))

    while at < last:
        m = TOKEN.search(source, at, last)
        if m is None:
            break
        text(m.start())
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = end  # a comment that never ends
            continue
        tag = name.lower()
        if tag not in INLINE:
            runs.append((-1, ""))
        elif tag == "br":
            runs.append((stack.nodes[-1], " "))
        if closing:
            stack.close(tag)
            continue
        stack.make_room(tag)
        words: list[str] = []
        mark = None
        if rest and "=" in rest:
            for kind, a, b, c in ATTRIBUTE.findall(rest):
                if kind.lower() == "data-y":
                    mark = a or b or c
                else:
                    words += [w.lower() for w in _WORDS.findall(a or b or c)]
        node = len(tags)
        tags.append(tag)
        page.parents.append(stack.nodes[-1])
        page.words.append(words)
        page.marks.append(mark)
        if tag in VOID or rest.endswith("/") and rest[-2:-1] in ("", " ", "\t", "\n", '"', "'"):
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(source, at)
            at = close.end() if close else end
            continue  # never main text
        stack.push(node, tag)
    cut_off = _CUT_OFF.search(source, at)  # a tag that the page ends in
    text(cut_off.start() if cut_off else end)
    return page


#: Kinds of elements whose potentials are counted apart.
_PARTS = frozenset("li ul ol dl dt dd tr td th tbody thead tfoot table caption colgroup option figcaption summary".split())
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre address".split())


def kind_of(tag: str, words: list[str]) -> str:
    kind = "inline" if tag in INLINE else "part" if tag in _PARTS else "text" if tag in _TEXTS else "box"
    return f"{kind}+" if words else kind


def _bucket(n: int) -> int:
    return 0 if n == 0 else 1 if n < 25 else 2 if n < 100 else 3 if n < 400 else 4


def node_features(page: Page) -> list[list[str]]:
    """Names of what is observed of each element."""
    n = len(page.tags)
    chars, linked, stops = [0] * n, [0] * n, [0] * n
    for node, t in page.runs:
        if node >= 0:
            chars[node] += len(t.strip())
            stops[node] += t.count(". ") + t.count("? ") + t.count("! ") + t.rstrip().endswith((".", "!", "?"))
    for node in range(n - 1, 0, -1):
        if page.tags[node] == "a":
            linked[node] = chars[node]
        parent = page.parents[node]
        chars[parent] += chars[node]
        linked[parent] += linked[node]
        stops[parent] += stops[node]
    out, whole = [], max(1, chars[0])
    for node in range(n):
        total = chars[node]
        share = linked[node] / total if total else 0.0
        kind = kind_of(page.tags[node], page.words[node])
        out.append(
            [
                f"{kind} tag {page.tags[node]}",
                f"{kind} length {_bucket(total)}",
                f"{kind} links {0 if share < 0.1 else 1 if share < 0.5 else 2}",
                f"{kind} stops {min(3, stops[node])}",
                *([f"{kind} share {int(4 * total / whole)}"] if kind.startswith("box") else ()),
                *(f"word {w}" for w in dict.fromkeys(page.words[node])),
            ]
        )
    return out


#: States of an element.
FRAME, CONTENT, REST = 0, 1, 2
_STATES = (FRAME, CONTENT, REST)


@dataclass
class ContentModel:
    """Log potentials: ``root[y]``, by the child's kind ``edge[kind][parent][child]`` and, by observation, ``node[name][y]``."""

    root: tuple[float, ...]
    edge: dict[str, tuple[tuple[float, ...], ...]]
    node: dict[str, tuple[float, ...]]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each element, by one pass up the tree and one down."""
        n, parents, get = len(page.tags), page.parents, self.node.get
        own = []
        for names in node_features(page):
            x = y = z = 0.0
            for name in names:
                got = get(name)
                if got is not None:
                    x += got[0]
                    y += got[1]
                    z += got[2]
            own.append([x, y, z])
        exp, log = math.exp, math.log
        tables = {kind: [[exp(v) for v in row] for row in edge] for kind, edge in self.edge.items()}  # [parent][child]
        down = [tables[kind_of(tag, words)] for tag, words in zip(page.tags, page.words, strict=True)]
        for y in _STATES:
            own[0][y] += self.root[y]
        up: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)] * n

        def weights(x: float, y: float, z: float) -> tuple[float, float, float]:
            top = max(x, y, z)
            return exp(max(x - top, -200.0)), exp(max(y - top, -200.0)), exp(max(z - top, -200.0))

        for i in range(n - 1, 0, -1):  # messages to parents
            a, b, c = weights(*own[i])
            up[i] = m = tuple([log(e[0] * a + e[1] * b + e[2] * c) for e in down[i]])
            above = own[parents[i]]
            for y in _STATES:
                above[y] += m[y]
        out = [0.0] * n
        # own[i] holds all but the parent's message; add that on the way down
        for i in range(n):
            here = own[i]
            if i:
                (d00, d01, d02), (d10, d11, d12), (d20, d21, d22) = down[i]
                m, above = up[i], own[parents[i]]
                a, b, c = weights(above[0] - m[0], above[1] - m[1], above[2] - m[2])
                here[0] += log(a * d00 + b * d10 + c * d20)
                here[1] += log(a * d01 + b * d11 + c * d21)
                here[2] += log(a * d02 + b * d12 + c * d22)
            a, b, c = weights(*here)
            out[i] = b / (a + b + c)
        return out

    def extract(self, source: str | None) -> str:
        page = parse(source)
        keep = [p >= 0.5 for p in self.marginals(page)]
        blocks, run = [], []
        for node, t in page.runs:
            if node < 0:
                if run:
                    blocks.append(" ".join("".join(run).split()))
                    run = []
            elif keep[node]:
                run.append(t)
        if run:
            blocks.append(" ".join("".join(run).split()))
        return "\n".join(b for b in blocks if b)


def states(page: Page) -> list[int]:
    """States of the elements of a page marked ``data-y="0|1"``.

    An element without a mark has its parent's, the page 0; of the elements
    marked 0, those with content below are frame.
    """
    marked: list[int] = []
    for node, mark in enumerate(page.marks):
        parent = page.parents[node]
        marked.append(int(mark) if mark in ("0", "1") else marked[parent] if parent >= 0 else 0)
    holds = marked.copy()
    for node in range(len(marked) - 1, 0, -1):
        holds[page.parents[node]] |= holds[node]
    # what stands inside the content but isn't part of it is the rest, whatever it holds
    return [CONTENT if m else FRAME if h else REST for m, h in zip(marked, holds, strict=True)]


#: Weight of potentials from an element's text: it is seen in all the elements around it, too.
DAMPING = 0.6
KINDS = tuple(k + w for k in ("inline", "part", "text", "box") for w in ("", "+"))


def fit(pages: list[str], smoothing: float = 0.03) -> ContentModel:
    """Counts the potentials from marked pages."""
    edge, root, seen, names = Counter(), Counter(), Counter(), Counter()
    for source in pages:
        page = parse(source)
        y = states(page)
        for node, observed in enumerate(node_features(page)):
            kind = kind_of(page.tags[node], page.words[node])
            seen[kind, y[node]] += 1
            if node:
                edge[kind, y[page.parents[node]], y[node]] += 1
            else:
                root[y[node]] += 1
            for name in observed:
                names[name, y[node]] += 1
    share = lambda k, total: math.log((k + smoothing) / (total + 3 * smoothing))
    every = {b: sum(n for (_, y), n in seen.items() if y == b) for b in _STATES}
    within = lambda name, b: every[b] if name.startswith("word ") else seen[name.split(" ", 1)[0], b]
    of = lambda kind, a: tuple(share(edge[kind, a, b], sum(edge[kind, a, c] for c in _STATES)) for b in _STATES)
    damped = lambda name: 1.0 if name.startswith("word ") or " tag " in name else DAMPING
    node = {name: tuple(damped(name) * share(names[name, b], within(name, b)) for b in _STATES) for name in {n for n, _ in names}}
    return ContentModel(tuple(share(root[b], sum(root.values())) for b in _STATES), {kind: tuple(of(kind, a) for a in _STATES) for kind in KINDS}, node)


# -- labelled pages ---------------------------------------------------------

#: Parts of a page that are not its article: (tags, class words).
JUNK = {
    "menu": (("nav", "div", "ul", "header"), ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "tabs", "toc")),
    "header": (("header", "div"), ("header", "masthead", "banner", "site", "top", "branding", "logo")),
    "footer": (("footer", "div"), ("footer", "bottom", "copyright", "legal", "colophon")),
    "sidebar": (("aside", "div", "section"), ("sidebar", "aside", "related", "widget", "recommended", "popular", "side", "rail", "more", "trending")),
    "notice": (("div", "section", "dialog"), ("cookie", "notice", "consent", "gdpr", "popup", "modal", "alert", "banner", "newsletter", "subscribe", "paywall")),
    "advert": (("div", "aside", "ins", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promoted", "adsbygoogle", "banner")),
    "form": (("form", "div"), ("form", "search", "login", "signup", "contact", "subscribe")),
    "comments": (("section", "div", "ol", "ul"), ("comments", "comment", "replies", "reply", "discussion", "disqus", "responses", "thread")),
    "subtitle": (("div", "p", "span"), ("subtitle", "tagline", "slogan", "motto", "site", "sub", "strapline")),
    "contents": (("div", "nav", "ul"), ("toc", "contents", "outline", "index", "jump")),
    "edit": (("span", "div"), ("edit", "edit-section", "permalink", "anchor", "tools", "actions")),
    "share": (("div", "ul"), ("share", "social", "sharing", "follow", "tags", "meta", "byline", "author", "print", "tools")),
}
ARTICLE_WORDS = ("article", "post", "content", "entry", "main", "body", "story", "text", "page", "blog", "news", "detail", "question", "message", "answer")


class PageMaker:
    """Random labelled pages; a seed gives the same ones."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.words(2, 18).capitalize() + self.r.choice(".....?!") for _ in range(self.r.randint(lo, hi)))

    def inline(self, text: str) -> str:
        r = self.r
        if r.random() < 0.3:
            text += f' <a href="/{r.randint(1, 99)}">{self.words(1, 3)}</a> {self.words(1, 5)}.'
        if r.random() < 0.25:
            tag = r.choice(("b", "em", "i", "strong", "span", "code"))
            text = f"<{tag}>{self.words(1, 4)}</{tag}> {text}"
        return text

    def junk(self, kind: str, bare: bool) -> str:
        r = self.r
        tags, names = JUNK[kind]
        tag = "div" if bare and r.random() < 0.7 else r.choice(tags)
        shown = "" if (bare or tag not in ("div", "section", "ul", "ol")) and kind != "subtitle" and r.random() < 0.6 else f' {r.choice(("class", "class", "id"))}="{" ".join(r.sample(names, r.randint(1, 2)))}"'
        links = lambda n: "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))
        if kind in ("menu", "header", "share"):
            inner = links(r.randint(2, 9)) if tag in ("ul", "ol") else f"<ul>{links(r.randint(2, 9))}</ul>" if r.random() < 0.7 else " | ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 8)))
            if kind == "header":
                inner = f"<p>{self.words(1, 4)}</p>{inner}"
        elif kind == "footer":
            said = f"&copy; {self.words(1, 3)} {r.choice(('&middot;', '|', '-', '2024'))} {self.sentences(1, 4)}"
            inner = r.choice((said, said, f"<p>{said}</p>", f"<p>{self.words(2, 8)}</p><ul>{links(3)}</ul>", f"{said}<p><a href=#>{self.words(1, 2)}</a></p>", f"<div>{links(4)}</div><small>{said}</small>"))
        elif kind == "subtitle":
            inner = self.words(2, 9).capitalize()
        elif kind == "contents":
            inner = (f"<h2>{self.words(1, 1)}</h2>" if tag != "ul" and r.random() < 0.5 else "") + (links(r.randint(2, 8)) if tag == "ul" else f"<ol>{links(r.randint(2, 8))}</ol>")
        elif kind == "edit":
            inner = r.choice((f'[<a href="#">{self.words(1, 1)}</a>]', f'<a href="#">{self.words(1, 2)}</a>', "&para;"))
        elif kind == "sidebar":
            inner = f"<h3>{self.words(1, 3)}</h3><ul>{links(r.randint(2, 7))}</ul>" + (f"<p>{self.sentences(1, 2)}</p>" if r.random() < 0.4 else "")
        elif kind in ("notice", "advert"):
            inner = r.choice((self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p><button>{self.words(1, 1)}</button>", f'<a href="/x">{self.words(2, 6)}</a>'))
        elif kind == "form":
            inner = f'<label>{self.words(1, 3)}</label><input name="q"><select><option>{self.words(1, 1)}<option>{self.words(1, 1)}</select><button>{self.words(1, 2)}</button>'
        else:
            said = lambda: f"<p>{self.sentences(1, 4)}</p>" if r.random() < 0.8 else self.sentences(1, 3)
            by = lambda: r.choice(("", f'<span class="author">{self.words(1, 2)}</span>', f"<b>{self.words(1, 2)}</b>", f'<a href="#">{self.words(1, 1)}</a>'))
            marked = r.choice(("", "", "", ' class="comment"', ' class="comment reply"', ' class="post comment-body"'))
            entry = "li" if tag in ("ol", "ul") else "div"
            shown = shown or f' class="{r.choice(names)}"'
            inner = "".join(f"<{entry}{marked}>{by()}{said()}</{entry}>" for _ in range(r.randint(1, 6)))
            if entry == "div" and r.random() < 0.5:
                inner = f"<h3>{r.randint(1, 40)} {self.words(1, 2)}</h3>" + (f"<ol>{inner.replace('<div', '<li').replace('</div>', '</li>')}</ol>" if r.random() < 0.6 else inner)
        return f'<{tag}{shown} data-y="0">{inner}</{tag}>'

    def item(self) -> str:
        """What stands in a cell or an entry of a list: a few words, or sentences."""
        r = self.r
        kind = r.random()
        if kind < 0.45:
            return self.words(1, 5).capitalize()
        if kind < 0.6:
            return f'<a href="/{r.randint(1, 99)}">{self.words(1, 2)}</a> {self.words(1, 6)}'
        return self.inline(self.sentences(1, 2))

    def listed(self) -> str:
        r = self.r
        n = r.randint(2, 9)
        kind = r.random()
        if kind < 0.5:
            tag = r.choice(("ul", "ul", "ol"))
            return f"<{tag}>{''.join(f'<li>{self.item()}' + r.choice(('</li>', '</li>', '')) for _ in range(n))}</{tag}>"
        if kind < 0.65:
            return f"<dl>{''.join(f'<dt>{self.words(1, 3)}</dt><dd>{self.item()}</dd>' for _ in range(n))}</dl>"
        width = r.randint(2, 5)
        head = f"<tr>{''.join(f'<th>{self.words(1, 2)}</th>' for _ in range(width))}</tr>" if r.random() < 0.6 else ""
        shown = f' class="{r.choice(("table", "data", "grid", "stats", "sortable"))}"' if r.random() < 0.4 else ""
        rows = "".join(f"<tr>{''.join(f'<td>{self.item() if r.random() < 0.4 else self.words(1, 3)}</td>' for _ in range(width))}</tr>" for _ in range(n))
        caption = f"<caption>{self.words(2, 6)}</caption>" if r.random() < 0.3 else ""
        return f"<table{shown}>{caption}{r.choice((head + rows, f'<thead>{head}</thead><tbody>{rows}</tbody>'))}</table>"

    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.6:
            start = r.choice(("", "", "", "<b>"))
            end = "<br>" if start else "</p>"
            return f"<p>{start}{self.inline(self.sentences(1, 7)) if r.random() < 0.85 else self.words(1, 3).capitalize() + '.'}{end}"
        if kind < 0.65:
            return f"<div{r.choice(('', ' class=\"para\"', ' class=\"paragraph text\"'))}>{self.inline(self.sentences(1, 6))}</div>"
        if kind < 0.75:
            return f"<{(tag := r.choice(('h2', 'h2', 'h3', 'h4')))}>{self.words(1, 7)}{self.junk('edit', False) if r.random() < 0.15 else ''}</{tag}>"
        if kind < 0.89:
            return self.listed()
        if kind < 0.92:
            return f"<blockquote>{r.choice((f'<p>{self.sentences(1, 3)}</p>', self.sentences(1, 2)))}</blockquote>"
        if kind < 0.96:
            return f"<pre>{r.choice((self.words(3, 20), f'<code>{self.words(3, 20)}</code>'))}</pre>"
        return f'<figure><img src="x.png"><figcaption>{r.choice((self.sentences(1, 1), self.words(2, 6)))}</figcaption></figure>'

    def article(self, bare: bool) -> str:
        r = self.r
        parts = [f"<h1>{self.words(2, 10).capitalize()}{r.choice(('.', ''))}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.12:
            parts.append(self.junk(r.choice(("subtitle", "contents", "share")), False))
        for _ in range(r.randint(1, 14)):
            parts.append(self.block())
            if r.random() < 0.07:
                parts.append(self.junk(r.choice(("advert", "share", "sidebar", "notice", "form", "contents")), False))
        inner = "".join(parts)
        if r.random() < 0.25:
            inner = "".join(f"<section>{x}</section>" for x in (inner, *(self.block() + self.block() for _ in range(r.randint(1, 3)))))
        if r.random() < 0.2:
            inner = f'<div{"" if bare else f" class={r.choice(ARTICLE_WORDS)}"}>{inner}</div>'
        if r.random() < 0.25:
            inner += self.junk("comments", False)
        tag = "div" if bare else r.choice(("article", "article", "article", "div", "section", "main"))
        named = tag == "article" or bare and r.random() < 0.5
        shown = "" if named and r.random() < 0.7 else f' {r.choice(("class", "class", "id"))}="{r.choice((" ", "-")).join(r.sample(ARTICLE_WORDS, r.randint(1, 2)))}"'
        if r.random() < 0.2:  # the title stands beside what holds the text
            title = f'<h1{r.choice(("", " id=firstHeading", " class=title", " class=entry-title"))} data-y="1">{self.words(1, 6).capitalize()}</h1>'
            if r.random() < 0.4:
                title += self.junk(r.choice(("subtitle", "share")), False)
            return f'<div{"" if bare else f" class={r.choice(ARTICLE_WORDS)}"}>{title}<{tag}{shown} data-y="1">{inner}</{tag}></div>'
        return f'<{tag}{shown} data-y="1">{inner}</{tag}>'

    def page(self) -> str:
        r = self.r
        bare = r.random() < 0.25
        before = [self.junk(k, bare) for k in ("header", "menu", "notice", "advert") if r.random() < 0.6] + [self.junk("subtitle", False)] * (r.random() < 0.12)
        after = [self.junk(k, bare) for k in ("share", "comments", "sidebar", "form", "advert", "footer") if r.random() < (0.7 if k == "comments" else 0.5)]
        r.shuffle(before)
        middle = self.article(bare)
        if r.random() < 0.3:
            middle = f'<div class="{r.choice(("container", "wrapper", "row", "layout", "grid"))}">{middle}{after.pop(0) if after else ""}</div>'
        elif r.random() < 0.2:
            middle = f"<main>{middle}</main>"
        head = f"<head><meta charset=utf-8><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var a='<p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]


#: Pages that the production model is fitted on.
TRAINING_PAGES, SEED = 2000, 11


@functools.cache
def production_model() -> ContentModel:
    """Fitted once a process."""
    return fit(labelled_pages(TRAINING_PAGES, SEED))


def extract_pages(pages: DataFrame, model: ContentModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page; no shuffle."""
    bounded_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
