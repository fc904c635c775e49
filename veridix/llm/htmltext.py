"""Operator 7: main text of web pages by a tree-structured graphical model.

The elements of a page are the nodes of a tree. A node's label says whether it belongs to the main text. Unary
potentials come from its tag, its class and id, and its text; parent-child potentials by the child's kind of tag tie
a label to its parent's. The weights are fitted by maximum likelihood on labelled pages. Sum-product messages go up
and down the tree once and give every node's exact marginal; blocks of nodes above one half are the main text.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.llm.common import bounded, read_table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WHITE = re.compile(r"\s+")
_UNCLOSED = re.compile(r"<[A-Za-z/!?][^>]*\Z")

#: Element kinds by tag; what isn't named is inline and no node.
_KINDS = {
    "article": "article", "main": "article", "section": "section", "div": "div", "body": "body", "html": "body", "p": "p", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "thead": "table", "tbody": "table", "tr": "table", "td": "cell", "th": "cell",
    "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form",
    "dialog": "aside", "address": "footer", "details": "section", "center": "div", "caption": "cell", "tfoot": "table", "hr": "div",
}
#: Scripts, styles, form controls and what no reader sees as text, wherever it stands. Everything else is up to the model.
_DROPPED = {"script", "style", "noscript", "template", "svg", "iframe", "select", "datalist", "button", "textarea", "title", "annotation", "annotation-xml", "audio", "video", "option", "optgroup", "input"}
_OPTIONS = ("option", "optgroup")  # their end tags may be left out
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_ENDS = re.compile(rf"</({'|'.join(sorted(_DROPPED - _RAW - _VOID - set(_OPTIONS)))})(?=[\s/>])", re.I)
_CLOSES_P = set(_KINDS) - {"body", "html", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
#: `text` is a run of text straight in the body.
KINDS = sorted({*_KINDS.values(), "text"})
_KIND_AT = {k: i for i, k in enumerate(KINDS)}
_GOOD = ("article", "content", "main", "post", "entry", "story", "text", "prose")
_BAD = ("nav", "menu", "side", "foot", "head", "ad", "ads", "advert", "advertisement", "promo", "sponsor", "sponsored", "banner", "comment", "comments", "reply", "replies", "disqus", "cookie", "consent", "notice", "alert", "share", "social", "related", "widget", "form", "login", "subscribe", "newsletter", "breadcrumb", "breadcrumbs", "pagination", "pager", "popup", "modal", "sidebar", "footer", "header", "toolbar", "meta", "byline", "tags", "recommend", "recommended", "copyright", "legal", "search", "signup")
FEATURES = 2 * len(KINDS) + 16


@dataclass
class Node:
    kind: str
    parent: int
    names: str
    hidden: bool = False
    within: bool = False  # an article or an element whose name speaks of one
    text: int = 0  # code points of its own text
    link: int = 0  # of those in links
    ends: int = 0  # sentence ends
    bold: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # node, text; in page order
    marked: bool = False  # has an article, or an element whose name speaks of one


def parse(source: str) -> Page:
    """Elements and blocks of a page. Unclosed elements end with the parent or, for paragraphs, items and cells, at the
    next one; stray end tags are ignored. What is dropped ends with the element it stands in at the latest, and a dropped
    element that no end tag follows hides nothing; a head needs no end tag, as all that belongs there is dropped."""
    page = Page([Node("body", -1, "")])
    nodes = page.nodes
    stack: list[tuple[str, int]] = [("html", 0)]  # open tags with their node
    parts: list[str] = []
    dropped: list[str] = []  # a dropped element and what is open in it
    ended: dict[str, int] = {}  # where the last end tag of each dropped element is
    for m in _ENDS.finditer(source):
        ended[m[1].lower()] = m.start()
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                at = stack[-1][1]
                if at == 0:
                    nodes.append(Node("text", 0, ""))
                    at = len(nodes) - 1
                page.blocks.append((at, text))
                nodes[at].text += len(text)
                nodes[at].link += linked
                nodes[at].ends += text.count(". ") + text.count("? ") + (text[-1] in ".?!。")
            linked = 0

    def close(depth: int) -> None:
        nonlocal links
        flush()
        for tag, _ in stack[depth:]:
            links -= tag == "a"
        del stack[depth:]

    def words(s: str) -> None:
        nonlocal linked
        if s and not dropped:
            parts.append(s)
            if links > 0:
                linked += len(s.strip())

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            words(_UNCLOSED.sub("", source[at:]))
            break
        words(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in dropped:
                del dropped[len(dropped) - 1 - dropped[::-1].index(tag) :]
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if not depth or "template" in dropped:
                continue
            dropped.clear()
            if tag in _KINDS:
                close(depth)
            elif not any(t in _KINDS for t, _ in stack[depth + 1 :]):
                links -= sum(t == "a" for t, _ in stack[depth:])
                del stack[depth:]
            continue
        alone = tag in _VOID or m[3].endswith("/")
        if tag in _RAW and not alone:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if dropped and dropped[0] in _OPTIONS and tag in _CLOSES_P:
            dropped.clear()
        if dropped or tag in _DROPPED:
            if tag in _OPTIONS and tag in dropped:
                del dropped[len(dropped) - 1 - dropped[::-1].index(tag) :]
            if not alone and (dropped or tag in _OPTIONS or ended.get(tag, -1) >= at):
                dropped.append(tag)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                words(" ")
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag not in _KINDS:
            if not m[3].endswith("/"):
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
            continue
        flush()
        if tag in _CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p" or stack[i][0] in _KINDS and stack[i][0] not in ("p",)), 0)
            if depth and stack[depth][0] == "p":
                close(depth)
        same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(tag)
        if same:
            wall = ("ul", "ol", "dl", "menu") if tag in ("li", "dt", "dd") else ("table",)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in wall:
                    break
                if stack[i][0] in same:
                    close(i)
                    break
        names = " ".join(x for g in _NAMES.findall(m[3]) for x in g).lower() if m[3] else ""
        over = nodes[stack[-1][1]]
        nodes.append(Node(_KINDS[tag], stack[-1][1], names, bool(m[3] and _HIDDEN.search(m[3])), over.within or over.kind == "article" or _named(over) == (True, False)))
        if not m[3].endswith("/"):
            stack.append((tag, len(nodes) - 1))
    flush()
    page.marked = any(x.kind == "article" or _named(x) == (True, False) for x in nodes)
    return page


def _named(node: Node) -> tuple[bool, bool]:
    """Whether its names speak of an article, and of something else."""
    names = set(re.split(r"[^a-z]+", node.names)) if node.names else set()
    return bool(names & set(_GOOD)), bool(names & set(_BAD))


def node_features(page: Page, node: Node) -> list[tuple[int, float]]:
    """The node's active features and their values."""
    k = 2 * len(KINDS)
    out = [(_KIND_AT[node.kind], 1.0), (len(KINDS) + _KIND_AT[page.nodes[max(node.parent, 0)].kind], 1.0)]
    if node.names:
        good, bad = _named(node)
        if good != bad:
            out.append((k + bad, 1.0))
        elif good:  # content-sidebar: either
            out.append((k + 9, 1.0))
        if bad and node.kind == "article":
            out.append((k + 10, 1.0))
    if node.hidden:
        out.append((k + 2, 1.0))
    if node.text:
        out.append((k + 3, 1.0))
        out.append((k + 4, min(1.0, node.link / node.text)))
        out.append((k + 5, min(math.log1p(node.text), 8.0) / 8))
        if node.ends:
            out.append((k + 6, 1.0))
    if node.parent == 0:
        out.append((k + 7, 1.0))
    if node.within and node.kind == "footer":
        out.append((k + 11, 1.0))
    if node.kind == "header" and node.parent > 0:
        out.append((k + 14, 1.0))
    if node.parent > 0 and page.nodes[node.parent].kind == "header" and page.nodes[node.parent].parent > 0:
        out.append((k + 15, 1.0))
    if not page.marked:
        out.append((k + 12, 1.0))
        if node.kind == "div":
            out.append((k + 13, 1.0))
    out.append((k + 8, 1.0))  # bias
    return out


@dataclass
class Model:
    unary: list[float]
    edge: dict[str, float]  # by the child's kind


def marginals(page: Page, model: Model) -> list[float]:
    """Exact P(label = main text) of each node by one upward and one downward pass. The root is a node like any other:
    where it is main text, the article stands straight in the body."""
    nodes = page.nodes
    n = len(nodes)
    own = [sum(model.unary[i] * v for i, v in node_features(page, x)) for x in nodes]
    # a child's message about its parent, as log-odds: 2 atanh(tanh(edge) tanh(own / 2))
    up = [0.0] * n
    total = own[:]
    for i in range(n - 1, 0, -1):
        t = math.tanh(model.edge[nodes[i].kind]) * math.tanh(max(-30.0, min(30.0, total[i])) / 2)
        up[i] = 2 * math.atanh(max(-1 + 1e-15, min(1 - 1e-15, t)))
        total[nodes[i].parent] += up[i]
    for i in range(1, n):
        rest = total[nodes[i].parent] - up[i]
        t = math.tanh(model.edge[nodes[i].kind]) * math.tanh(max(-30.0, min(30.0, rest)) / 2)
        total[i] += 2 * math.atanh(max(-1 + 1e-15, min(1 - 1e-15, t)))
    return [1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) for x in total]


def train(pages: list[tuple[Page, list[bool]]], ridge: float = 0.5, rounds: int = 400, rate: float = 0.1) -> Model:
    """Maximum likelihood by the exact gradient: what the labels show less what sum-product expects. All pages are one
    forest whose levels are passed through at once; steps are Adam's."""
    x, y, parent, depth, kind = [], [], [], [], []
    for page, labels in pages:
        first = len(y)
        level = [0] * len(page.nodes)
        for i, node in enumerate(page.nodes):
            row = np.zeros(FEATURES)
            for j, v in node_features(page, node):
                row[j] = v
            level[i] = level[node.parent] + 1 if i else 0
            x.append(row)
            y.append(labels[i])
            parent.append(first + max(node.parent, 0))
            depth.append(level[i])
            kind.append(_KIND_AT[node.kind])
    x, y, parent, depth, kind = np.array(x), np.array(y, float), np.array(parent), np.array(depth), np.array(kind)
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    inner = depth > 0
    sign = 2 * y - 1
    k = len(KINDS)
    w = np.zeros(FEATURES + k)
    w[FEATURES:] = 0.5
    shown = np.append(x.T @ y, np.bincount(kind[inner], weights=(sign * sign[parent])[inner], minlength=k))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        e = w[FEATURES:][kind]
        below = x @ w[:FEATURES]
        up = np.zeros(len(y))
        for at in levels[:0:-1]:
            up[at] = _message(e[at], below[at])
            np.add.at(below, parent[at], up[at])
        total, rest = below.copy(), np.zeros(len(y))
        for at in levels[1:]:
            rest[at] = total[parent[at]] - up[at]
            total[at] = below[at] + _message(e[at], rest[at])
        p = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
        s, d = np.clip(np.abs(rest + below) / 2, 0, 60), np.clip(np.abs(rest - below) / 2, 0, 60)
        same, apart = np.logaddexp(s, -s) + e, np.logaddexp(d, -d) - e
        both = np.tanh((same - apart) / 2)  # expected product of the two labels' signs
        expected = np.append(x.T @ p, np.bincount(kind[inner], weights=both[inner], minlength=k))
        g = (shown - expected - ridge * w) / len(pages)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(w[:FEATURES].tolist(), {name: float(w[FEATURES + i]) for name, i in _KIND_AT.items()})


def _message(edge: np.ndarray, odds: np.ndarray) -> np.ndarray:
    return 2 * np.arctanh(np.clip(np.tanh(edge) * np.tanh(np.clip(odds, -30, 30) / 2), -1 + 1e-15, 1 - 1e-15))


def labelled_pages(count: int = 800, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Made-up pages and the blocks of their main text: articles amid menus, notices, adverts, comments and forms; in
    wrappers with all kinds of names, with headers of their own, or straight in the body, as elements or bare text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ta", "ri", "no", "sel", "um", "ka", "der", "lo", "mi", "ent")) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice((".", ".", "!", "?"))
    par = lambda: " ".join(say(1, 14) for _ in range(rng.choice((1, 1, 2, 5, 9))))
    out = []
    for _ in range(count):
        text: list[str] = []
        shape = rng.random()
        wrapper = rng.choice(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='content'>{}</div>", "<div id='main'><div class='post'>{}</div></div>", "<article class='post'><section>{}</section></article>", "<div class='article-body'>{}</div>", "<div>{}</div>", "<div><div>{}</div></div>"))
        enclosed = shape >= 0.35 and rng.random() < 0.5
        inside = shape >= 0.35 and (enclosed or "<article" in wrapper or "<main" in wrapper)

        def body(depth: int = 0, text: list[str] = text) -> str:
            s = ""
            for _ in range(rng.randint(1, 9)):
                kind = rng.choice(("p", "p", "p", "p", "h2", "ul", "quote", "table", "div", "aside", "ad", "share", "nav", "note"))
                if kind == "p":
                    t = par()
                    text.append(t)
                    a = t.split()
                    if len(a) > 4 and rng.random() < 0.3:
                        a[1], a[2] = f"<a href='/x'>{a[1]}", f"{a[2]}</a>"
                    s += rng.choice(("<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p class=x>{}</p>", "<div>{}</div>")).format(" ".join(a))
                elif kind == "h2":
                    text.append(word())
                    s += f"<h2>{text[-1]}</h2>"
                elif kind == "ul":
                    items = [say(1, 9) for _ in range(rng.randint(1, 4))]
                    text += items
                    s += "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
                elif kind == "quote":
                    text.append(par())
                    s += f"<blockquote>{text[-1]}</blockquote>"
                elif kind == "table":
                    cells = [word() for _ in range(4)]
                    text += cells
                    s += "<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>".format(*cells)
                elif kind == "note":  # what an article's own footer or address says
                    text.append(par())
                    s += rng.choice(("<footer><p>{}</p></footer>", "<footer>{}</footer>", "<address>{}</address>")).format(text[-1]) if inside else f"<div>{text[-1]}</div>"
                elif kind == "div" and depth < 2:
                    s += f"<div>{body(depth + 1)}</div>"
                elif kind == "aside":
                    s += f"<aside><h3>{word()}</h3><p>{par()}</p></aside>"
                elif kind == "ad":
                    s += f"<div class='{rng.choice(('ad', 'ad-box', 'promo', 'sponsor', 'banner ads'))}'>{rng.choice((par(), '<p>' + par() + '</p>', '<a href=/y>' + say(2, 6) + '</a>'))}</div>"
                elif kind == "share":
                    tag = rng.choice(("div", "div", "footer"))
                    s += f"<{tag} class='{rng.choice(('share', 'social-links', 'related', 'newsletter', 'tags'))}'><ul>" + "".join(f"<li><a href=/s>{word()}</a></li>" for _ in range(3)) + f"</ul></{tag}>"
                elif kind == "nav":
                    s += "<nav>" + "".join(f"<a href=/t>{word()}</a> " for _ in range(3)) + "</nav>"
            return s

        links = lambda: "<ul>" + "".join(f"<li><a href=/z>{word()}</a></li>" for _ in range(rng.randint(1, 7))) + "</ul>"
        before = [
            f"<nav>{links()}</nav>", f"<header><h1>{say(1, 4)}</h1>{links()}</header>", f"<div class='{rng.choice(('menu', 'top-nav', 'header', 'breadcrumb'))}'>{links()}</div>",
            f"<div class='{rng.choice(('cookie', 'notice', 'consent-banner', 'alert'))}'><p>{par()}</p></div>", f"<form action=/q><p>{say(1, 4)}</p><div>{word()}</div></form>", f"<div>{links()}</div>", f"<div class='{rng.choice(('ad', 'advert', 'promo'))}'>{par()}</div>",
        ]
        after = [
            f"<aside><h2>{word()}</h2>{links()}<p>{par()}</p></aside>", f"<div id='{rng.choice(('sidebar', 'side', 'widget'))}'><p>{par()}</p>{links()}</div>",
            f"<section class='{rng.choice(('comments', 'comment-list'))}'><h3>{word()}</h3>" + "".join(f"<div class=comment><p>{par()}</p></div>" for _ in range(rng.randint(1, 4))) + "</section>",
            f"<footer><p>{par()}</p>{links()}</footer>", f"<footer>&copy; {say(1, 9)}</footer>", f"<div class='footer'>{par()}</div>", f"<div class='related'>{links()}</div>", f"<form class='login'><p>{say(1, 5)}</p></form>",
        ]
        s = "".join(rng.sample(before, rng.randint(0, 4)))
        text.append(say(1, 7))
        title = f"<h1>{text[-1]}</h1>"
        if shape < 0.15:  # old pages: runs of text with line breaks between, in inline tags
            runs = [par() for _ in range(rng.randint(1, 4))]
            text += [" ".join(runs)]
            inner = rng.choice(("<br><br>", "<br>")).join(rng.choice(("{}", "<font size=2>{}</font>", "<span>{}</span>")).format(r) for r in runs)
            inner = title + inner + (f"<p>{text.append(par()) or text[-1]}</p>" if rng.random() < 0.5 else "")
        elif shape < 0.35:  # paragraphs straight in the body
            inner = title + body(2)
        else:
            if rng.random() < 0.3:
                text[-1:] = [text[-1], *([say(2, 9)] if rng.random() < 0.5 else [])]
                title = f"<header{rng.choice(('', ' class=entry-header', ' class=post-header'))}>{title}" + "".join(f"<p>{t}</p>" for t in text[1:]) + "</header>"
            inner = title + body()
            side = rng.choice(("sidebar", "side", "header", "ad", "social", "comments", "nav", "footer"))
            own = rng.choice(("", "", f" class='article-{side}-{word()}'", f" class='post has-{side}'", f" class='{word()} no-{side}'", f" class='{side}-{word()} entry'", f" id='{word()}'"))
            if enclosed:
                inner = rng.choice(("<article{0}>{1}</article>", "<main{0}>{1}</main>", "<article{0}><div>{1}</div></article>")).format(own, inner)
        wrap = "{}" if shape < 0.35 or enclosed else wrapper
        s += wrap.format(inner) + "".join(rng.sample(after, rng.randint(0, 5)))
        out.append((f"<html><head><title>x</title></head><body>{s}</body></html>", text))
    return out


def node_labels(page: Page, text: list[str]) -> list[bool]:
    """Labels from the main text's blocks: a node of which, all below it included, most text is main text and that, the
    root aside, doesn't merely hold the page's one article; of the root, most of what stands straight in it."""
    left = {}
    for t in text:
        left[t] = left.get(t, 0) + 1
    mine, all_ = [0] * len(page.nodes), [0] * len(page.nodes)
    for node, t in page.blocks:
        size = len(t)
        all_[node] += size
        if left.get(t, 0):
            left[t] -= 1
            mine[node] += size
    for i in range(len(page.nodes) - 1, 0, -1):
        mine[page.nodes[i].parent] += mine[i]
        all_[page.nodes[i].parent] += all_[i]
    out = [2 * m > a for m, a in zip(mine, all_, strict=True)]
    # a body whose main text is all in one wrapper isn't main text itself
    top = [i for i, x in enumerate(page.nodes) if x.parent == 0 and out[i]]
    out[0] = len(top) > 1
    return out


_MODEL: list[Model] = []


def default_model() -> Model:
    """The model fitted on labelled_pages(), once a process."""
    if not _MODEL:
        pages = [(parse(s), text) for s, text in labelled_pages()]
        _MODEL.append(train([(p, node_labels(p, text)) for p, text in pages]))
    return _MODEL[0]


def main_text(source: str | None, model: Model) -> str:
    page = parse(source or "")
    if not page.blocks:
        return ""
    p = marginals(page, model)
    return "\n\n".join(t for node, t in page.blocks if p[node] > 0.5)


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars (code points): blocks of main text in page order, white
    space inside a block as one space, joined by an empty line.

    Whole pages, whatever their length. Null and empty html, and pages without main text, give the empty string;
    repeated rows are extracted each; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            text = [main_text(s, sent.value) for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


QUERIES = {"op7_html": op7_html}
ORACLE: dict[str, str] = {}
