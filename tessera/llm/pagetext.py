"""Main text of web pages by a tree-structured graphical model.

Every block element and every run of text of a page is a node with a hidden label:
does what stands below it belong to the article? A node's features give its own
potential, each edge of the tree a potential of the labels of parent and child.
Sum-product messages go up the tree and down again and give exact marginals; runs of
text with a marginal of a half or more are the article. Weights are trained by maximum
likelihood, with the same messages, on labelled pages from ``labelled_pages``.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg math head title textarea select canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input button".split())
#: What an opening tag ends when it is open just above it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: What such an end never reaches beyond.
SCOPE = frozenset("ul ol dl table body html article section div main td th".split())
TAGS = "html body main article section div nav header footer aside form ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table tbody thead tr td th blockquote pre figure figcaption address details summary fieldset center #text".split()
#: Parts of class, id and role names by what they tend to mark.
HINTS = {
    "content": "article content post entry story main text body prose maincontent page-content articlebody",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip",
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion banner-ad adsense adbox dfp",
    "side": "sidebar side aside related widget rail recommended recommend trending popular share social tags complementary",
    "head": "header masthead banner top logo brand topbar site-header",
    "foot": "footer foot bottom copyright legal contentinfo colophon",
    "comment": "comment comments reply replies respond response disqus discussion thread feedback commentlist",
    "notice": "cookie cookies notice consent gdpr alert modal popup overlay newsletter subscribe signup paywall dialog",
    "form": "form search login searchbox register contact",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_NAME = re.compile(r"[a-z]+(?:-[a-z]+)*")


class Node:
    __slots__ = ("attrs", "children", "label", "links", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, attrs: str = "") -> None:
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.text, self.links, self.children, self.label = "", 0, 0, None


def parse(page: str) -> list[Node]:
    """The block tree of a page in page order, parents first: block elements, and a ``#text`` node for each run of text in one block.

    Takes any string: tags left open are closed by what must follow them, stray ends
    are ignored, and elements whose text is never shown are left out whole.
    """
    nodes, stack = [Node("html", -1)], [0]
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag, so that no search walks it
    opened: list[str] = []  # inline elements since the last block
    n_opened: Counter = Counter()
    absent: set[str] = set()  # what does not occur in the rest of the page
    run: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            n = Node("#text", stack[-1])
            n.text, n.links = text, links
            nodes.append(n)
            nodes[stack[-1]].children += 1
        links = 0

    def put(text: str) -> None:
        nonlocal links
        if text:
            run.append(text)
            if n_opened["a"] or n_opened["button"]:
                links += len(text)

    def cut(place: int) -> None:
        """Closes the block at that place of the stack and all in it."""
        while len(stack) > place:
            open_at[nodes[stack.pop()].tag].pop()

    def none_opened() -> None:
        opened.clear()
        n_opened.clear()

    def find(what: str) -> int:
        """Where this comes next; -1 if never."""
        where = -1 if what in absent else low.find(what, at)
        if where < 0:
            absent.add(what)
        return where

    def highest(tags: Iterable[str]) -> int:
        """The last place in the stack, beyond the root, of any of the tags; 0 for none."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    at, n = 0, len(page)
    low = None
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        close, tag = m.group(1), m.group(2)
        if tag:
            tag = tag.lower()
            if tag in DROPPED:
                if not m.group(3).endswith("/") or tag not in ("svg", "math"):
                    low = low if low is not None else page.lower()
                    end = find(f"</{tag}")
                    if tag == "head":  # left out up to what cannot stand in it
                        ends = [x for x in (end, find("<body")) if x >= 0]
                        end = min(ends) if ends else -1
                        at = at if end < 0 else end
                    else:
                        close_at = low.find(">", end) if end >= 0 else -1
                        at = n if end < 0 or close_at < 0 else close_at + 1
                    if end < 0 and tag == "head":
                        continue
                if tag not in ("script", "style", "noscript", "template"):
                    run.append(" ")
            elif tag in INLINE:
                if tag in ("br", "img", "input"):
                    run.append(" ")
                elif tag not in VOID:
                    opened.append(tag)
                    n_opened[tag] += 1
            else:
                flush()
                if tag == "html" or (tag == "body" and open_at["body"]):
                    continue
                if len(stack) > 1 and nodes[stack[-1]].tag == "p":
                    cut(len(stack) - 1)
                ends = ENDS.get(tag)
                while ends and (place := highest(ends)) > highest(SCOPE - ends):
                    cut(place)
                    if tag not in ("thead", "tbody", "tfoot", "tr"):
                        break
                none_opened()
                if tag not in VOID:
                    nodes.append(Node(tag, stack[-1], m.group(3)))
                    nodes[stack[-1]].children += 1
                    open_at[tag].append(len(stack))
                    stack.append(len(nodes) - 1)
        elif close:
            close = close.lower()
            if close in INLINE:
                while n_opened[close]:
                    last = opened.pop()
                    n_opened[last] -= 1
                    if last == close:
                        break
            elif close not in DROPPED:
                flush()
                place = highest((close,))
                if place and (close != "p" or place == len(stack) - 1):
                    cut(place)
                    none_opened()
        elif m.group().startswith("<![CDATA["):
            put(html.escape(m.group()[9:-3]))
    flush()
    return nodes


_TAG = {t: i for i, t in enumerate(TAGS)}
_KINDS = {k: i for i, k in enumerate(HINTS)}
_OFF_HINT = len(TAGS) + 1
_OFF_MORE = _OFF_HINT + len(HINTS)
N_FEATURES = _OFF_MORE + 40
#: Edge potentials by the sort of the child.
EDGES = 4


def _edge(tag: str) -> int:
    return 0 if tag == "#text" else 1 if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "tr", "dd", "dt") else 2 if tag in ("div", "section", "center", "table", "tbody", "ul", "ol") else 3


def featurise(nodes: list[Node]) -> list[list[int]]:
    """For each node the numbers of its features."""
    out = []
    total = sum(len(n.text) for n in nodes) or 1
    seen = 0
    for i, n in enumerate(nodes):
        f = [_TAG.get(n.tag, len(TAGS))]
        if n.attrs:
            hidden = False
            names = set()
            for m in _ATTR.finditer(n.attrs):
                key = m.group(1).lower()
                value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
                if key in ("class", "id", "role", "aria-label"):
                    for w in _NAME.findall(value):
                        names.update([w, *w.split("-")])
                elif key == "style":
                    hidden |= "display:none" in value.replace(" ", "")
                elif key == "aria-hidden":
                    hidden |= value == "true"
            f += sorted({_OFF_HINT + _KINDS[_HINT[w]] for w in names if w in _HINT})
            if hidden or re.search(r"(?:^|\s)hidden(?:\s|$)", n.attrs):
                f.append(_OFF_MORE)
        if n.tag == "#text":
            words, share = n.text.count(" ") + 1, n.links / len(n.text)
            f.append(_OFF_MORE + 1 + min(7, int(math.log2(words))))
            f.append(_OFF_MORE + 9 + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3))
            f.append(_OFF_MORE + 13 + (n.text[-1] in ".!?…\"'»”。"))
            f.append(_OFF_MORE + 15 + (nodes[n.parent].tag in ("p", "h1", "h2", "h3", "blockquote", "pre")))
            if "©" in n.text or "all rights reserved" in n.text.lower():
                f.append(_OFF_MORE + 17)
            f.append(_OFF_MORE + 18 + min(9, 10 * seen // total))
            if n.links and n.text.count("|") + n.text.count("·") + n.text.count("»") > 1:
                f.append(_OFF_MORE + 28)
            seen += len(n.text)
        else:
            f.append(_OFF_MORE + 29 + min(5, n.children.bit_length()))
        out.append(f)
    return out


Weights = tuple[list[float], list[list[float]]]


def messages(nodes: list[Node], features: list[list[int]], weights: Weights) -> tuple[list[float], list[tuple[float, ...]]]:
    """(marginal of label 1 of each node, the four joint marginals of each node and its parent).

    Two passes of sum-product over the tree, leaves to root and back.
    """
    unary, pair = weights
    n = len(nodes)
    own = [math.exp(max(-30.0, min(30.0, sum(map(unary.__getitem__, f))))) for f in features]  # odds of label 1
    up0, up1 = [1.0] * n, own[:]
    to0, to1 = [1.0] * n, [1.0] * n  # message of a node to its parent
    psi = [tuple(map(math.exp, p)) for p in pair]
    kind = [_edge(x.tag) for x in nodes]
    for i in range(n - 1, 0, -1):
        a, b = up0[i], up1[i]
        s = a + b
        a, b = a / s, b / s
        up0[i], up1[i] = a, b
        p00, p01, p10, p11 = psi[kind[i]]
        m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
        to0[i], to1[i] = m0, m1
        p = nodes[i].parent
        up0[p] *= m0
        up1[p] *= m1
        s = up0[p] + up1[p]
        up0[p] /= s
        up1[p] /= s
    bel0, bel1 = [0.0] * n, [0.0] * n
    s = up0[0] + up1[0]
    bel0[0], bel1[0] = up0[0] / s, up1[0] / s
    joint: list[tuple[float, ...]] = [(0.0,) * 4] * n
    for i in range(1, n):
        p = nodes[i].parent
        p00, p01, p10, p11 = psi[kind[i]]
        r0, r1 = bel0[p] / to0[i], bel1[p] / to1[i]  # the parent's belief without this child
        j = (r0 * p00 * up0[i], r0 * p01 * up1[i], r1 * p10 * up0[i], r1 * p11 * up1[i])
        s = sum(j)
        j = (j[0] / s, j[1] / s, j[2] / s, j[3] / s)
        joint[i] = j
        bel0[i], bel1[i] = j[0] + j[2], j[1] + j[3]
    return bel1, joint


def fit(pages: list[tuple[list[Node], list[int]]], epochs: int = 5, rate: float = 0.25, decay: float = 2e-4) -> Weights:
    """Maximum likelihood by steps over the pages: what features and edges the labels have, less what the marginals expect."""
    unary, pair = [0.0] * N_FEATURES, [[1.0, -1.0, 0.0, 0.0] for _ in range(EDGES)]
    gu, gp = [1e-2] * N_FEATURES, [[1e-2] * 4 for _ in range(EDGES)]
    prepared = [(nodes, featurise(nodes), y) for nodes, y in pages]
    for _ in range(epochs):
        for nodes, features, y in prepared:
            one, joint = messages(nodes, features, (unary, pair))
            step: dict[int, float] = {}
            for f, p, label in zip(features, one, y):
                d = label - p
                if d > 1e-4 or d < -1e-4:
                    for k in f:
                        step[k] = step.get(k, 0.0) + d
            for k, d in step.items():
                d -= decay * unary[k]
                gu[k] += d * d
                unary[k] += rate * d / math.sqrt(gu[k])
            edges = [[0.0] * 4 for _ in range(EDGES)]
            for i in range(1, len(nodes)):
                e = edges[_edge(nodes[i].tag)]
                e[2 * y[nodes[i].parent] + y[i]] += 1
                for k in range(4):
                    e[k] -= joint[i][k]
            for e, (g, w) in enumerate(zip(gp, pair)):
                for k in range(4):
                    d = edges[e][k] - decay * w[k]
                    g[k] += d * d
                    w[k] += rate * d / math.sqrt(g[k])
    return unary, pair


def labels(nodes: list[Node]) -> list[int]:
    """1 for text under the mark data-y=1 (the nearest mark counts) and for all above it."""
    mark = []
    for n in nodes:
        m = re.search(r"data-y=([01])", n.attrs)
        mark.append(int(m[1]) if m else mark[n.parent] if n.parent >= 0 else 0)
    y = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].tag == "#text" and mark[i]:
            y[i] = 1
        if y[i] and nodes[i].parent >= 0:
            y[nodes[i].parent] = 1
    return y


def labelled_pages(count: int, seed: int = 0) -> list[str]:
    """Pages of many layouts whose article text is marked data-y=1 and the rest data-y=0."""
    rng = random.Random(seed)
    pick = rng.choice

    def words(a: int, b: int) -> str:
        b = b if rng.random() < 0.85 or b < 60 else 6 * b
        out = ["".join(pick("bcdfglmnprst") + pick("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b))]
        for i in range(rng.randint(4, 12), len(out) - 1, rng.randint(6, 14)):
            out[i] += pick((".", ".", ","))
        if rng.random() < 0.03 and len(out) > 6:
            out = [w for w in out[: len(out) // 4 + 1] for _ in range(rng.randint(2, 20))]
        if rng.random() < 0.04:
            out = [w + pick(("", "***", " |", "%%%", " ·")) for w in out]
        return (" ".join(out)).capitalize() + "."

    def link(a: int = 1, b: int = 4) -> str:
        return f'<a href="/x">{words(a, b)[:-1]}</a>'

    def listed(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"

    def named(tag: str | None, hints: str) -> tuple[str, str]:
        """An element known by its tag or by a class, an id or a role."""
        if tag and rng.random() < 0.55:
            return f"<{tag} data-y=0>", f"</{tag}>"
        name = pick(HINTS[hints].split())
        name = pick((name, name, f"site-{name}", f"{name}-box", f"c {name}"))
        return f'<div {pick(("class", "class", "id"))}="{name}" data-y=0>', "</div>"

    def boiler(kind: str) -> str:
        if kind == "menu":
            a, b = named("nav", kind)
            return a + pick((listed(rng.randint(2, 9)), " | ".join(link() for _ in range(rng.randint(2, 7))))) + b
        if kind == "head":
            a, b = named("header", kind)
            return a + pick(("", f"<h1>{words(1, 4)[:-1]}</h1>", f"<p>{words(2, 9)}</p>")) + pick(("", listed(4), f"<div>{words(1, 6)}</div>")) + b
        if kind == "foot":
            a, b = named("footer", kind)
            return a + pick((f"&copy; {words(2, 20)}", f"<p>{words(4, 25)}</p><p>&copy; 2020 {words(1, 5)}</p>", listed(5) + f"<p>{words(3, 30)}</p>", f"&copy; m.example.com &middot; {words(4, 20)}")) + b
        if kind == "side":
            a, b = named("aside", kind)
            return a + pick((f"<h3>{words(1, 4)[:-1]}</h3>" + listed(rng.randint(2, 8)), f"<p>{words(5, 60)}</p><p>{words(5, 50)}</p>", f"<h2>{words(1, 3)[:-1]}</h2><p>{words(8, 40)}</p>" + listed(3))) + b
        if kind == "advert":
            a, b = named(None, kind)
            return a + pick((words(3, 30), f"<p>{words(3, 40)}</p>", f'<a href="/b">{words(2, 12)}</a>')) + b
        if kind == "notice":
            a, b = named(None, kind)
            return a + pick((f"<p>{words(5, 40)}</p><button>{words(1, 2)}</button>", words(6, 30) + f"<button>{words(1, 2)}</button>", f"<h2>{words(2, 5)}</h2><p>{words(5, 25)}</p>")) + b
        if kind == "form":
            a, b = named("form", kind)
            return a + f"<label>{words(1, 3)}</label><input name=q><p>{words(2, 14)}</p><button>{words(1, 2)}</button>" + b
        tag = pick(("section", "div", "ol"))
        name = pick(HINTS["comment"].split())
        item = "li" if tag == "ol" else pick(("div", "article", "div"))
        one = lambda: f'<{item} class="{pick(("comment", "reply", "comment-body", "response", "c"))}"><p>{pick(("<b>" + words(1, 2)[:-1] + "</b> ", ""))}{words(3, 70)}</p></{item}>'
        return f'<{tag} {pick(("id", "class"))}="{name}" data-y=0><h3>{words(1, 3)[:-1]}</h3>' + "".join(one() for _ in range(rng.randint(1, 6))) + f"</{tag}>"

    def block() -> str:
        return pick((
            *[lambda: f"<p>{words(1, 90)}</p>"] * 12,
            lambda: f"<p>{words(1, 6)}</p>",
            lambda: f"<p>{words(5, 30)[:-1]} {link()} {words(5, 30)}</p>",
            lambda: f"<p><b>{words(3, 30)}<br>",
            lambda: f"<h2>{words(2, 8)[:-1]}</h2>",
            lambda: f"<blockquote>{pick(('', '<p>'))}{words(5, 40)}</blockquote>",
            lambda: "<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>",
            lambda: "<table><tr>" + "".join(f"<td>{words(1, 6)}</td>" for _ in range(4)) + "</tr></table>",
            lambda: f"<div>{words(5, 60)}</div>",
            lambda: f"<pre>{words(3, 20)}</pre>",
            lambda: f"<p>{pick(('All rights reserved.', 'Copyright 2019 ' + words(1, 4), words(3, 9)))}</p>",
            lambda: f"<p>{words(1, 3)}</p>" * rng.randint(3, 12),
        ))()

    out = []
    for _ in range(count):
        tag, attrs = pick((("article", ""), ("article", ' class="post"'), ("article", ""), ("main", ""), ("div", f' {pick(("id", "class"))}="{pick(HINTS["content"].split())}"'), ("section", ' class="story"'), ("div", "")))
        inner = [f"<h1>{words(2, 14)[:-1]}</h1>"] * (rng.random() < 0.8) + [block() for _ in range(rng.randint(1, 14) if rng.random() < 0.9 else rng.randint(15, 40))]
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            inner.insert(rng.randint(1, len(inner)), boiler(pick(("advert", "side", "notice", "form"))))
        if rng.random() < 0.2:
            inner.append(boiler("comment"))
        body = f"<{tag}{attrs} data-y=1>" + "".join(inner) + f"</{tag}>"
        if tag != "main" and rng.random() < 0.3:
            body = f"<main>{body}{boiler(pick(('side', 'comment', 'form')))}</main>"
        before = [boiler(k) for k in ("notice", "head", "menu", "advert", "form", "menu", "side") if rng.random() < 0.45]
        after = [boiler(k) for k in ("side", "comment", "form", "side", "advert", "notice", "foot") if rng.random() < 0.45]
        if rng.random() < 0.3:
            rng.shuffle(before)
        page = "".join(before) + body + "".join(after)
        if rng.random() < 0.35:
            page = f'<div class="{pick(("wrapper", "container", "page", "layout"))}">{page}</div>'
        out.append(f"<html><head><title>{words(2, 6)}</title><script>a='</p>'</script></head><body data-y=0>{page}</body></html>")
    return out


@cache
def default_weights(count: int = 1200, seed: int = 11) -> Weights:
    pages = [parse(p) for p in labelled_pages(count, seed)]
    return fit([(n, labels(n)) for n in pages])


def extract(page: str | None, weights: Weights) -> str:
    """The article's blocks joined by newlines; empty if there is none."""
    if not page:
        return ""
    nodes = parse(page)
    one, _ = messages(nodes, featurise(nodes), weights)
    return "\n".join(n.text for n, p in zip(nodes, one) if n.tag == "#text" and p >= 0.5)


def extract_pages(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id_col, *keep, text, n_chars) for each row, from its whole html.

    Null and empty pages, and pages without an article, have empty text. Rows that
    repeat give the same text each; an empty table gives no rows.
    """
    learned = weights or default_weights()
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return pd.Series([extract(h, learned) for h in html], index=html.index, dtype=object)

    found = pages.select(id_col, *keep, run(F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
