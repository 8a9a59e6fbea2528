"""Markup residue in documents: minimum-cut labelling, twice, then one pass of edits.

First, everything that may be markup is a node: a tag, an entity, a pair of stars, a heading's signs, a command, a
formula. A logistic classifier, fitted here on labelled snippets of :func:`labelled_snippets`, says from a node's shape and
its place in the line how much it looks like markup; its log-odds are the capacities to the two terminals. Smoothness
edges tie nodes of the same markup that follow each other closely and, more strongly, nodes that the document tree puts
together: the opening and closing of one element, the rows of one table, the items of one list. The minimum cut splits
the nodes into markup and content, so that a lone star or dollar stays text while the same sign among its like does not.

Second, in pages, the blocks of text between block elements are nodes. A classifier fitted on :func:`labelled_blocks` weighs
the elements they stand in, their links, words and sentence ends; neighbours are tied, more strongly in one parent element.
The cut separates content from boilerplate: navigation, scripts, styles and footers do not come out.

A node whose own cost outweighs all its edges has its label in every minimum cut; those are settled first, and only what
remains needs augmenting paths. Code samples (fenced, verbatim, preformatted, or indented by four spaces or a tab) hold no
nodes and come out as they are. Formulas count as LaTeX but stay in the text. What is a heading (and its level), a list
item, a code sample or a formula in the clean text is told beside it.
"""

from __future__ import annotations

import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.entities import html5
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"
NEAR = 400
NEAR_EDGE, LIST_EDGE, TREE_EDGE = 0.35, 0.6, 2.0
BLOCK_EDGE, SAME_PARENT = 0.2, 0.6
#: The most a classifier may say for one node.
MOST = 3.5

# fixed values: element names, and commands that stand without braces
_ELEMENTS = frozenset((
    "a", "abbr", "article", "aside", "b", "big", "blockquote", "body", "br", "button", "center", "cite", "code", "col", "colgroup", "dd", "del",
    "details", "dfn", "div", "dl", "dt", "em", "fieldset", "figcaption", "figure", "font", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "i", "iframe", "img", "input", "ins", "kbd", "label", "li", "link", "main", "mark", "meta", "nav", "noscript",
    "object", "ol", "option", "p", "pre", "q", "s", "samp", "script", "section", "select", "small", "span", "strike", "strong", "style", "sub",
    "summary", "sup", "svg", "table", "tbody", "td", "template", "textarea", "tfoot", "th", "thead", "title", "tr", "tt", "u", "ul", "var", "video",
))
_BREAKING = frozenset((
    "p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "tr", "blockquote", "pre", "br", "hr", "body",
    "html", "head", "header", "footer", "nav", "figure", "form", "title",
))
_COMMANDS = frozenset((
    "item", "noindent", "newline", "par", "centering", "hline", "maketitle", "tableofcontents", "clearpage", "newpage", "bigskip", "medskip",
    "smallskip", "quad", "qquad", "ldots", "dots", "cdot", "times", "sum", "int", "frac", "alpha", "beta", "gamma", "delta", "lambda", "mu", "pi",
    "sigma", "theta", "leq", "geq", "neq", "infty", "rightarrow", "to", "LaTeX", "TeX",
))
_PLAIN_ENVIRONMENTS = ("verbatim", "lstlisting")

_CODE = re.compile(
    r"(?ms)^(?P<open>[ \t]{0,3}(?P<fence>```+|~~~+)[^\n]*\n)(?P<fenced>.*?)(?P<close>^[ \t]{0,3}(?P=fence)[ \t]*$)"
    r"|(?P<pre><pre\b[^>]*>(?:[ \t]*<code\b[^>]*>)?)(?P<kept>.*?)(?P<end>(?:</code>[ \t]*)?</pre>)"
    r"|(?P<begin>\\begin\{(?P<env>verbatim|lstlisting)\}(?:\[[^\]\n]*\])?)(?P<verb>.*?)(?P<finish>\\end\{(?P=env)\})"
)
_INDENTED = re.compile(r"\n(?:    |\t)[^\n]*")
#: Where a node can start at all; only there is the long pattern tried.
_START = re.compile(r"[<&\[{~`$\\*_!|#:='+-]")
_NODE = re.compile(
    r"(?P<comment><!--.*?-->)"
    r"|(?P<tag></?(?P<name>[a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>\n]*)?/?>)"
    r"|(?P<entity>&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,31});)"
    r"|(?P<atx>^#{1,6}[ \t]+(?=\S))"
    r"|(?P<image>!\[[^\]\n]*\]\([^()\n]*\))"
    r"|(?P<wlink>\[\[[^\[\]\n]+\]\])"
    r"|(?P<link>\[[^\[\]\n]+\](?:\([^()\n]*\)|\[[^\[\]\n]*\]))"
    r"|(?P<external>\[https?://[^\s\]]+ [^\]\n]+\])"
    r"|(?P<definition>^\[[^\]\n]+\]:[ \t]+\S+[^\n]*$)"
    r"|(?P<template>\{\{[^{}\n]+\}\})"
    r"|(?P<wtable>^(?:\{\|[^\n]*|\|\}|\|-[^|\n]*)$)"
    r"|(?P<rule>^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$)"
    r"|(?P<row>^\|[^\n]*\|[ \t]*$)"
    r"|(?P<wrow>^[|!] ?[^|\n-][^\n]*$)"
    r"|(?P<wheading>^(?P<eq>={2,6})[ \t]*[^=\n]+?[ \t]*(?P=eq)[ \t]*$)"
    r"|(?P<underline>(?<=\n)(?:-{3,}|={3,})[ \t]*$)"
    r"|(?P<task>^[-*+][ \t]+\[[ xX]\][ \t])"
    r"|(?P<witem>^[*#:;]{2,}[ \t]?|^:[ \t]?(?=\S))"
    r"|(?P<bullet>^[-*+][ \t]+(?=\S))"
    r"|(?P<strong>\*\*(?=\S)[^*\n]+\*\*|(?<!\w)__(?=[^\s_])[^\n]*?[^\s_]__(?!\w))"
    r"|(?P<strike>~~(?=\S)[^~\n]+~~)"
    r"|(?P<tick>`[^`\n]+`)"
    r"|(?P<quotes>'{2,5}(?=[^'\s])[^'\n]+'{2,5})"
    r"|(?P<formula>\$\$[^$]+\$\$|\$[^$\n]+\$|\\\([^\n]*?\\\)|\\\[.*?\\\])"
    r"|(?P<environment>\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*)"
    r"|(?P<command>\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})+)"
    r"|(?P<bare>\\[a-zA-Z]+\b\*?)"
    r"|(?P<escape>\\[%&#_{}])"
    r"|(?P<em>(?<![\w*])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]*[^\s_]_(?![\w_]))",
    re.M | re.S,
)
_KIND = {
    "comment": HTML, "tag": HTML, "entity": HTML,
    "atx": MARKDOWN, "image": MARKDOWN, "link": MARKDOWN, "definition": MARKDOWN, "rule": MARKDOWN, "row": MARKDOWN, "underline": MARKDOWN, "task": MARKDOWN,
    "bullet": MARKDOWN, "strong": MARKDOWN, "strike": MARKDOWN, "tick": MARKDOWN, "em": MARKDOWN, "fence": MARKDOWN,
    "wlink": WIKI, "external": WIKI, "template": WIKI, "wtable": WIKI, "wrow": WIKI, "wheading": WIKI, "witem": WIKI, "quotes": WIKI,
    "environment": LATEX, "command": LATEX, "escape": LATEX, "formula": LATEX, "bare": LATEX,
}
_FORMULA_SIGN = re.compile(r"[\\^_{}]|^\$?[A-Za-z]\$?$|[A-Za-z] ?=")


class Node(NamedTuple):
    start: int
    end: int
    kind: str
    shape: str
    cost: float
    name: str


def _code_nodes(body: str) -> tuple[list[Node], list[tuple[int, int]], list[tuple[int, int]]]:
    """(nodes, spans that hold no other nodes, the code within these)."""
    nodes, spans, inner = [], [], []
    marked = "```" in body or "~~~" in body or "<pre" in body or "\\begin{" in body
    for m in _CODE.finditer(body) if marked else ():
        for ends, shape, names in ((("open", "close"), "fence", ("", "")), (("pre", "end"), "tag", ("pre", "/pre")), (("begin", "finish"), "environment", ("", ""))):
            if m.group(ends[0]):
                nodes += [_node(body, m.start(end), m.end(end), shape, name) for end, name in zip(ends, names)]
        spans.append((m.start(), m.end()))
        inner.append(next(m.span(g) for g in ("fenced", "kept", "verb") if m.group(g) is not None))
    indented = [(m.start() + 1, m.end()) for m in _INDENTED.finditer(body)]
    if body.startswith(("    ", "\t")):
        indented.append((0, body.find("\n") if "\n" in body else len(body)))
    return nodes, sorted(spans + indented), sorted(inner + indented)


def node_features(body: str, start: int, end: int, shape: str, name: str) -> tuple[str, ...]:
    """What the classifier sees of a node: its shape with what tells it from its look-alikes, and its place in the line."""
    text, kind = body[start:end], shape
    if shape == "tag":
        kind = "tag:element" if name.lstrip("/") in _ELEMENTS else "tag:other"
    elif shape == "entity":
        kind = "entity:known" if text[1] == "#" or text[1:] in html5 else "entity:other"
    elif shape == "formula":
        inner = text.strip("$")
        signs = text[0] == "\\" or _FORMULA_SIGN.search(inner) and not inner[:1].isspace() and not inner[-1:].isspace()
        kind = "formula:signs" if signs else "formula:plain"
    elif shape == "bare":
        known = text[1:].rstrip("*") in _COMMANDS and body[start - 1 : start] not in (":", "\\")
        kind = "bare:known" if known else "bare:other"
    alone = (start == 0 or body[start - 1] == "\n") and body[end : end + 1] in ("\n", "")
    return ("bias", kind, f"{shape}:alone" if alone else f"{shape}:within")


@lru_cache(4096)
def _log_odds(features: tuple[str, ...]) -> float:
    weights = fitted_nodes()
    return max(-MOST, min(MOST, sum(weights.get(f, 0.0) for f in features)))


def _node(body: str, start: int, end: int, shape: str, name: str, cost: float | None = None) -> Node:
    return Node(start, end, _KIND[shape], shape, _log_odds(node_features(body, start, end, shape, name)) if cost is None else cost, name)


def nodes_of(body: str, cost: float | None = None) -> list[Node]:
    """The possible markup of a body, in order, none inside a code sample."""
    nodes, spans, _ = _code_nodes(body) if cost is None else ([], [], [])
    at = 0
    gaps = []
    for start, end in spans:
        if start > at:
            gaps.append((at, start))
        at = max(at, end)
    gaps.append((at, len(body)))
    match = _NODE.match
    for low, high in gaps:
        at = low
        for start in _START.finditer(body, low, high):
            if start.start() < at:
                continue
            m = match(body, start.start(), high)
            if not m:
                continue
            at = m.end()
            shape = m.lastgroup if m.lastgroup not in ("name", "eq") else ("tag" if m.group("tag") else "wheading")
            name = "/" * m.group().startswith("</") + m.group("name").lower() if shape == "tag" else ""
            nodes.append(_node(body, m.start(), m.end(), shape, name, cost))
    nodes.sort()
    return nodes


# --- training -------------------------------------------------------------------------------------------------


def labelled_snippets(count: int = 6000, seed: int = 5) -> list[tuple[str, bool]]:
    """(snippet, is markup): what markup looks like, and what in plain text looks like it, by their odds in mixed documents."""
    rng = random.Random(seed)
    word = lambda: rng.choice("river stone market window early quiet seven letter garden copper".split())
    some = lambda: " ".join(word() for _ in range(rng.randint(1, 4)))
    yes = [
        lambda: f"<{rng.choice(['p', 'div', 'b', 'li', 'td', 'span'])}>", lambda: f"</{rng.choice(['p', 'ul', 'em', 'h2'])}>", lambda: f'<a href="{word()}.htm">', lambda: f"<!-- {some()} -->",
        lambda: rng.choice(["&amp;", "&#8217;", "&nbsp;", "&lt;"]), lambda: f"{'#' * rng.randint(1, 4)} {some()}", lambda: f"![{some()}]({word()}.png)", lambda: f"[{some()}](https://{word()}.test)",
        lambda: f"[{word()}]: https://{word()}.test", lambda: "| --- | :--- |", lambda: f"| {word()} | {word()} |", lambda: f"{some()}\n-----", lambda: f"{some()}\n=====", lambda: f"- [x] {some()}",
        lambda: f"{rng.choice('-*+')} {some()}", lambda: f"**{some()}**", lambda: f"~~{some()}~~", lambda: f"{word()} `{some()}` {word()}", lambda: f"{word()} *{some()}* {word()}", lambda: f"{word()} _{some()}_ {word()}",
        lambda: f"[[{some()}|{word()}]]", lambda: f"[https://{word()}.test {some()}]", lambda: f"{{{{{word()}|{word()}}}}}", lambda: f"{{| class={word()}", lambda: "|-", lambda: f"== {some()} ==", lambda: f"{word()} ''{some()}'' {word()}",
        lambda: f"\\begin{{{word()}}}", lambda: f"\\section{{{some()}}}", lambda: f"\\emph{{{some()}}}", lambda: "$x_1 = y^2$", lambda: "\\(a + b\\)", lambda: f"\\item {some()}", lambda: f"{word()} \\alpha {word()}", lambda: f"{word()} 7\\% {word()}",
    ]
    both = [lambda: f"- {some()}", lambda: f"* {some()}", lambda: f"| {some()}", lambda: f": {some()}", lambda: f"## {word()}\n## {word()}"[3:], lambda: f"{word()} \\_ {word()}", lambda: f"{word()} *{word()}* {word()}"]
    no = [
        lambda: f"{word()} <{word()}> {word()}", lambda: f"List<{word()}>", lambda: f"A&{word()}; {word()}", lambda: f"{word()} $5 and 10$ {word()}", lambda: f"${rng.randint(1, 99)} or ${rng.randint(1, 99)}",
        lambda: f"C:\\{word()}", lambda: f"{word()} \\{word()} {word()}", lambda: f"| {word()}: {rng.randint(1, 99)}", lambda: f"- {some()}, {some()}", lambda: f": {some()}", lambda: f"! {some()}",
    ]
    found = []
    for _ in range(count):
        kind = rng.random()
        if kind < 0.6:
            found.append((rng.choice(yes)(), True))
        elif kind < 0.75:
            found.append((rng.choice(both)(), rng.random() < 0.45))
        else:
            found.append((rng.choice(no)(), False))
    return found


def labelled_blocks(count: int = 4000, seed: int = 6) -> list[tuple[tuple[str, ...], bool]]:
    """(features, is boilerplate) of the blocks of invented pages."""
    rng = random.Random(seed)
    found = []
    for _ in range(count):
        where = rng.choice(["nav", "footer", "aside", "header", "form", "main", "main", "main", "none", "none", "none", "none"])
        dull = where in ("nav", "footer", "form") and rng.random() < 0.93 or where in ("aside", "header") and rng.random() < 0.6 or where in ("main", "none") and rng.random() < 0.08
        links = rng.choice([0.7, 0.9, 1.0, 0.2]) if dull else rng.choice([0.0, 0.0, 0.05, 0.2])
        words = rng.randint(1, 9) if dull else rng.choice([rng.randint(2, 9), rng.randint(8, 80)])
        found.append((block_features((where,), links, words, not dull and words > 4 and rng.random() < 0.8, where == "header" and not dull or rng.random() < 0.1), dull))
    return found


def _fit(rows: list[tuple[tuple[str, ...], bool]]) -> dict[str, float]:
    """Weights of a logistic classifier, by Newton steps with a small ridge."""
    index: dict[str, int] = {}
    ids = [[index.setdefault(f, len(index)) for f in features] for features, _ in rows]
    x, y = np.zeros((len(rows), len(index))), np.array([label for _, label in rows], float)
    for row, own in zip(x, ids):
        row[own] = 1.0
    weights = np.zeros(len(index))
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ weights))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(index)), x.T @ (y - p) - 0.5 * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(index, weights.tolist()))


@lru_cache(1)
def fitted_nodes() -> dict[str, float]:
    rows = []
    for text, label in labelled_snippets():
        rows += [(node_features(text, n.start, n.end, n.shape, n.name), label) for n in nodes_of(text, 0.0)]
    return _fit(rows)


@lru_cache(1)
def fitted_blocks() -> dict[str, float]:
    return _fit(labelled_blocks())


# --- the cuts -------------------------------------------------------------------------------------------------


def edges_of(nodes: list[Node]) -> list[tuple[int, int, float]]:
    """Smoothness edges: near nodes of one kind, items and rows that follow each other, elements' two ends."""
    edges, last, opened = [], {}, {}
    for i, node in enumerate(nodes):
        before = last.get(node.kind)
        if before is not None and node.start - nodes[before].end <= NEAR:
            like = node.shape == nodes[before].shape and node.shape in ("bullet", "row", "wrow", "witem", "task", "rule", "wtable")
            table = node.kind in (MARKDOWN, WIKI) and {node.shape, nodes[before].shape} <= {"row", "rule", "wrow", "wtable"}
            edges.append((before, i, LIST_EDGE if like or table else NEAR_EDGE))
        last[node.kind] = i
        if node.shape == "tag":
            if node.name.startswith("/"):
                stack = opened.get(node.name[1:])
                if stack:
                    edges.append((stack.pop(), i, TREE_EDGE))
            else:
                opened.setdefault(node.name, []).append(i)
    return edges


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node falls on the markup side of the minimum cut."""
    count = len(costs)
    pull = [0.0] * count
    for a, b, capacity in edges:
        pull[a] += capacity
        pull[b] += capacity
    labels: list[bool | None] = [cost > 0 if abs(cost) > pull[i] else None for i, cost in enumerate(costs)]
    open_nodes = [i for i in range(count) if labels[i] is None]
    if not open_nodes:
        return labels
    place = {node: k for k, node in enumerate(open_nodes)}
    source, sink = len(open_nodes), len(open_nodes) + 1
    rest: list[dict[int, float]] = [{} for _ in range(sink + 1)]

    def add(a: int, b: int, there: float, back: float) -> None:
        rest[a][b] = rest[a].get(b, 0.0) + there
        rest[b][a] = rest[b].get(a, 0.0) + back

    unary = [costs[node] for node in open_nodes]
    for a, b, capacity in edges:
        ka, kb = place.get(a), place.get(b)
        if ka is not None and kb is not None:
            add(ka, kb, capacity, capacity)
        elif ka is not None:
            unary[ka] += capacity if labels[b] else -capacity
        elif kb is not None:
            unary[kb] += capacity if labels[a] else -capacity
    for k, cost in enumerate(unary):
        if cost > 0:
            add(source, k, cost, 0.0)
        elif cost < 0:
            add(k, sink, -cost, 0.0)
    while True:
        came = {source: -1}
        queue = deque([source])
        while queue and sink not in came:
            here = queue.popleft()
            for there, capacity in rest[here].items():
                if capacity > 1e-9 and there not in came:
                    came[there] = here
                    queue.append(there)
        if sink not in came:
            break
        flow, there = float("inf"), sink
        while there != source:
            flow = min(flow, rest[came[there]][there])
            there = came[there]
        there = sink
        while there != source:
            here = came[there]
            rest[here][there] -= flow
            rest[there][here] = rest[there].get(here, 0.0) + flow
            there = here
    for node, k in place.items():
        labels[node] = k in came
    return labels


def markup_nodes(body: str | None) -> list[Node]:
    """The nodes of a body that are markup."""
    if not body:
        return []
    nodes = nodes_of(body)
    labels = minimum_cut([n.cost for n in nodes], edges_of(nodes))
    return [n for n, is_markup in zip(nodes, labels) if is_markup]


_DULL = ("nav", "footer", "aside", "header", "form", "main")
_HIDDEN = ("script", "style", "noscript", "template", "head")
_BLOCKS = frozenset(("p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "blockquote", "pre", "body", "html", "header", "footer", "nav", "aside", "figure", "form"))


def block_features(inside: tuple[str, ...], links: float, words: int, ends_well: bool, heads: bool) -> tuple[str, ...]:
    """What the classifier sees of a block: the elements about it, the share of linked text, its words, a sentence's end, a heading."""
    share = "links:most" if links > 0.6 else "links:some" if links > 0.1 else "links:few"
    size = "words:1" if words < 3 else "words:3" if words < 10 else "words:10" if words < 25 else "words:25"
    return ("bias", share, size, *(f"in:{name}" for name in _DULL if name in inside), *(("sentence",) if ends_well else ()), *(("heading",) if heads else ()))


def boilerplate(body: str, found: list[Node]) -> list[tuple[int, int]]:
    """Spans of a page that are no content: hidden elements, and the blocks on the boilerplate side of the minimum cut."""
    tags = [n for n in found if n.shape == "tag"]
    if not any(n.name in _BLOCKS or n.name in _HIDDEN for n in tags):
        return []
    spans: list[tuple[int, int]] = []
    blocks: list[list] = []  # start, end, elements about it, id of the parent, characters linked
    stack: list[tuple[str, int]] = []
    at, linked, opened, hidden = 0, 0, None, None

    def settle(upto: int) -> None:
        nonlocal at, linked
        if hidden is None and body[at:upto].strip():
            blocks.append([at, upto, tuple(name for name, _ in stack), stack[-1][1] if stack else -1, linked])
        at, linked = upto, 0

    for number, tag in enumerate(tags):
        name = tag.name.lstrip("/")
        if hidden is not None:
            if tag.name == "/" + hidden[0]:
                spans.append((hidden[1], tag.start))
                hidden, at, linked = None, tag.end, 0
            continue
        if name in _HIDDEN and tag.name[0] != "/":
            if f"</{name}" in body[tag.end :].lower():
                settle(tag.start)
                hidden = (name, tag.end)
            continue
        if name == "a":
            if tag.name[0] != "/":
                opened = tag.end
            elif opened is not None:
                linked, opened = linked + tag.start - opened, None
            continue
        if name not in _BLOCKS:
            continue
        settle(tag.start)
        at = tag.end
        if tag.name[0] != "/":
            stack.append((name, number))
        elif any(n == name for n, _ in stack):
            while stack.pop()[0] != name:
                pass
    settle(len(body))
    costs, edges = [], []
    weights = fitted_blocks()
    for k, (low, high, inside, parent, chars) in enumerate(blocks):
        plain = _ANY_TAG.sub(" ", body[low:high]).strip()
        heads = bool(inside) and inside[-1][0] == "h" and inside[-1][1:].isdigit()
        features = block_features(inside, chars / max(1, len(plain)), len(plain.split()), plain.endswith((".", "!", "?", "…", ":")), heads)
        costs.append(max(-MOST, min(MOST, sum(weights.get(f, 0.0) for f in features))))
        if k:
            edges.append((k - 1, k, BLOCK_EDGE + (SAME_PARENT if blocks[k - 1][3] == parent else 0.0)))
    dull = minimum_cut(costs, edges)
    return sorted(spans + [(low, high) for (low, high, *_), cut in zip(blocks, dull) if cut])


_ANY_TAG = re.compile(r"<[^<>]*>")
_LINK_TEXT = re.compile(r"!?\[([^\]]*)\]")
_GROUPS = re.compile(r"\{([^{}\n]*)\}")


def _instead(body: str, node: Node) -> str:
    """What stands in the clean text for a markup node."""
    text = body[node.start : node.end]
    shape = node.shape
    if shape == "tag":
        name = node.name.lstrip("/")
        if name == "li":
            return "" if node.name[0] == "/" else "- "
        if name in ("td", "th"):
            return "\t" if node.name[0] == "/" else ""
        if name == "br":
            return "\n" if body[node.end : node.end + 1] != "\n" else ""
        if name == "pre":
            return "\n" if node.start and node.name[0] != "/" and body[node.start - 1] != "\n" else ""
        return "\n" if name in _BREAKING and node.name[0] == "/" and body[node.end : node.end + 1] not in ("\n", "") else ""
    if shape == "entity":
        return unescape(text)
    if shape in ("comment", "definition", "rule", "wtable", "environment", "atx", "underline", "fence"):
        return ""
    if shape in ("image", "link"):
        return _LINK_TEXT.match(text).group(1)
    if shape == "wlink":
        return text[2:-2].rsplit("|", 1)[-1]
    if shape == "external":
        return text[1:-1].split(" ", 1)[1]
    if shape == "template":
        parts = text[2:-2].split("|")
        return parts[-1] if len(parts) > 1 and "=" not in parts[-1] else ""
    if shape in ("row", "wrow"):
        return "\t".join(cell.strip() for cell in re.split(r"\|\|?|!!", text.strip().strip("|!")))
    if shape == "wheading":
        return text.strip().strip("=").strip()
    if shape in ("task", "bullet", "witem"):
        return "- "
    if shape in ("strong", "strike", "em"):
        return text.strip("*_~")
    if shape == "tick":
        return text[1:-1]
    if shape == "quotes":
        return text.strip("'")
    if shape == "command":
        groups = _GROUPS.findall(text)
        return text if text.startswith(("\\frac", "\\sqrt")) else groups[-1] if groups and not text.startswith(("\\label", "\\ref", "\\cite", "\\vspace", "\\hspace")) else ""
    if shape == "bare":
        return "- " if text == "\\item" else "" if text[1:] in ("noindent", "newline", "par", "centering", "hline", "maketitle", "clearpage", "newpage") else text
    if shape == "escape":
        return text[1:]
    return text  # formulas stay


_SECTION = re.compile(r"\\((?:sub)*)(?:section|paragraph|chapter|part)\b")


def _structure(body: str, node: Node) -> tuple[str, int] | None:
    """(kind, level) of what begins at a node: a heading, a list item or a formula."""
    text = body[node.start : node.end]
    if node.shape == "atx":
        return "heading", text.count("#")
    if node.shape == "wheading":
        return "heading", len(text) - len(text.lstrip("="))
    if node.shape == "command" and (m := _SECTION.match(text)):
        return "heading", 1 + m.group(1).count("sub")
    if node.shape == "tag" and node.name[:1] == "h" and node.name[1:].isdigit():
        return "heading", int(node.name[1:])
    if node.shape in ("task", "bullet", "witem") or node.name == "li" or node.shape == "bare" and text == "\\item":
        return "item", 1
    return ("formula", 0) if node.shape == "formula" else None


def clean(body: str | None, offsets: list[int] = ()) -> tuple[str | None, list[int], set[str], list[tuple[str, int, int, int]]]:
    """(clean text, where each offset of the body now points, kinds of markup found, structure).

    ``structure`` lists (kind, level, start, end) in the clean text of its headings, items, formulas and code samples.
    """
    if not body:
        return body, [0 for _ in offsets], set(), []
    found = markup_nodes(body)
    samples = _code_nodes(body)[2]
    drops = boilerplate(body, found)
    dropped = {low for low, _ in drops}
    # edits in order: markup nodes, and spans that are left out whole
    edits = sorted([(n.start, n.end, n) for n in found] + [(low, high, None) for low, high in drops], key=lambda e: (e[0], -e[1]))
    parts, at, size = [], 0, 0
    marks = sorted(range(len(offsets)), key=lambda i: offsets[i])
    moved = [0] * len(offsets)
    structure: list[list] = []
    k = c = 0

    def settle(upto: int) -> None:
        nonlocal k, c
        while k < len(marks) and offsets[marks[k]] <= upto:
            moved[marks[k]] = size + max(0, offsets[marks[k]] - at)
            k += 1
        while c < len(samples) and samples[c][0] < upto:
            low, high = max(samples[c][0], at), samples[c][1]
            if low < high and body[low:high].strip():
                structure.append(["code", 0, size + low - at, size + high - at])
            c += 1

    for start, end, node in edits:
        if start < at:
            continue
        settle(start)
        parts.append(body[at:start])
        size += start - at
        at = start
        # an item whose block is left out leaves no sign
        text = _instead(body, node) if node and node.end not in dropped else ""
        # offsets inside a node point at the start of what stands for it
        while k < len(marks) and offsets[marks[k]] < end:
            moved[marks[k]] = size
            k += 1
        told = _structure(body, node) if node and node.end not in dropped else None
        if told:
            structure.append([*told, size, -1 if told[0] != "formula" else size + len(text)])
        elif node and node.shape == "underline" and parts and (before := "".join(parts).rstrip("\n")):
            start_of = before.rfind("\n") + 1
            structure.append(["heading", 1 if body[node.start] == "=" else 2, start_of, len(before)])
        parts.append(text)
        size += len(text)
        at = end
    settle(len(body) + 1)
    parts.append(body[at:])
    while k < len(marks):
        moved[marks[k]] = size + len(body) - at
        k += 1
    whole = "".join(parts)
    told = []
    for kind, level, start, end in structure:
        if end < 0:  # up to the end of the line
            while start < len(whole) and whole[start] == "\n":
                start += 1
            end = whole.find("\n", start)
            end = len(whole) if end < 0 else end
        if start < min(end, len(whole)):
            told.append((kind, level, start, min(end, len(whole))))
    return whole, [min(m, len(whole)) for m in moved], {n.kind for n in found}, sorted(told, key=lambda t: (t[2], t[3]))


def clean_texts(texts: DataFrame) -> DataFrame:
    """(text_id, markup, clean_body, sections, structure) of every row.

    ``markup`` lists the kinds found, sorted; sections keep their names and order, with offsets into
    clean_body, and structure says what in it is a heading, an item, a code sample or a formula. Null bodies stay null, with offsets 0; null sections stay null; offsets beyond the body point
    at its end. There is no shuffle.
    """
    pair = pa.struct([("section_name", pa.string()), ("start_offset", pa.int32())])
    part = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("start_offset", pa.int32()), ("end_offset", pa.int32())])
    schema = pa.schema([("text_id", pa.int64()), ("markup", pa.list_(pa.string())), ("clean_body", pa.string()), ("sections", pa.list_(pair)), ("structure", pa.list_(part))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for key, body, sections in zip(*(batch.column(i).to_pylist() for i in range(3))):
                offsets = [max(0, (s or {}).get("start_offset") or 0) for s in sections or ()]
                text, moved, kinds, structure = clean(body, offsets)
                named = None if sections is None else [{"section_name": (s or {}).get("section_name"), "start_offset": m} for s, m in zip(sections, moved)]
                for column, value in zip(out, (key, sorted(kinds), text, named, [dict(zip(("kind", "level", "start_offset", "end_offset"), t)) for t in structure])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    kinds = "text_id long, markup array<string>, clean_body string, sections array<struct<section_name:string,start_offset:int>>, structure array<struct<kind:string,level:int,start_offset:int,end_offset:int>>"
    return texts.select("text_id", "body", "sections").mapInArrow(run, kinds)


def markup_kinds(texts: DataFrame) -> DataFrame:
    """(text_id, markup): one row per text and kind of markup; repeated text_ids count once."""
    schema = pa.schema([("text_id", pa.int64()), ("markup", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, kind) for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for kind in sorted({n.kind for n in markup_nodes(body)})]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts.select("text_id", "body").filter(F.length("body") > 0).mapInArrow(run, "text_id long, markup string").distinct()
