"""A small HTML reader: blocks as a tree of nodes, with features of each node.

Only block elements are nodes; text and links inside inline elements belong to the
block around them.  Unclosed, misnested and cut-off markup is taken as browsers do in
the common cases: a block closes an open paragraph, an end tag closes what is open
inside its element, an end tag without a start is ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np

#: Element names by role.
HIDDEN = {"script", "style", "template", "noscript", "iframe", "object", "svg", "math", "textarea", "select", "title", "head", "datalist", "canvas", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "ins", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ITEMS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = {"ul", "ol", "dl", "table", "menu", "div", "article", "section", "aside", "main", "nav", "body", "html", "form", "blockquote"}
TAGS = ("p", "li", "ul", "ol", "div", "article", "section", "main", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "h1", "h2", "h3", "blockquote", "pre", "figure", "button", "address")
#: Words in class, id and role names, by what they tell.
TOKENS = (
    ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "links", "topnav"),
    ("header", "masthead", "topbar", "banner", "logo", "branding", "top"),
    ("footer", "foot", "copyright", "legal", "bottom", "colophon"),
    ("sidebar", "side", "aside", "widget", "related", "rail", "recommended", "trending", "popular", "complementary", "more"),
    ("ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "dfp", "commercial"),
    ("cookie", "consent", "notice", "alert", "gdpr", "modal", "popup", "overlay", "dialog", "toast", "warning", "message", "paywall", "disclaimer"),
    ("comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "thread", "feedback", "reader", "readers", "responses"),
    ("share", "social", "sharing", "follow", "tweet", "facebook", "tags", "tag", "meta", "byline", "author", "toolbar", "tools"),
    ("form", "search", "searchbox", "newsletter", "subscribe", "subscription", "signup", "login", "register", "contact"),
    ("article", "content", "main", "post", "entry", "story", "body", "text", "page", "prose", "articlebody", "maincontent"),
)
_TOKEN_GROUP = {w: k for k, group in enumerate(TOKENS) for w in group}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_ATTRS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "groups", "parent", "children", "items", "order", "depth", "hidden", "inputs")

    def __init__(self, tag: str, groups: frozenset[int], parent: Node | None, order: int) -> None:
        self.tag, self.groups, self.parent, self.order = tag, groups, parent, order
        self.children: list[Node] = []
        #: Child nodes, and (text, inside a link) pieces, in page order.
        self.items: list = []
        self.depth = parent.depth + 1 if parent else 0
        self.inputs = 0


def _groups(attrs: str) -> frozenset[int]:
    found = set()
    for m in _ATTRS.finditer(attrs):
        value = _CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower()
        found.update(_TOKEN_GROUP[w] for w in _WORDS.findall(value) if w in _TOKEN_GROUP)
    return frozenset(found)


def parse(page: str) -> list[Node]:
    """Nodes in page order, the root first."""
    root = Node("html", frozenset(), None, 0)
    nodes = [root]
    stack: list[tuple[str, Node]] = [("html", root)]  # open elements and the block each is in
    open_: dict[str, int] = {}  # number of each name on the stack above the root
    links = 0
    hidden = 0
    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.match(page, at)
        if m is None:  # an unclosed tag at the end
            break
        at = m.end()
        if m[4] is not None:
            if not hidden:
                block = stack[-1][1]
                block.items.append((html.unescape(m[4]) if "&" in m[4] else m[4], links > 0))
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            # An end that nothing open has is no reason to look through the stack.
            while open_.get(tag):
                name, _ = stack.pop()
                open_[name] -= 1
                hidden -= name in HIDDEN
                links -= name == "a"
                if name == tag:
                    break
            continue
        attrs = m[3] or ""
        if tag == "br" or tag == "hr":
            stack[-1][1].items.append((" ", False))
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            stack[-1][1].inputs += tag == "input"
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in ("html", "body"):
            root.groups |= _groups(attrs)
            if tag == "body" and hidden:
                while len(stack) > 1:
                    stack.pop()
                open_.clear()
                hidden = links = 0
            continue
        if tag in BLOCK:
            ending = ITEMS.get(tag, ())
            searched = open_.get("p") or ending and any(open_.get(name) for name in ending)
            for k in range(len(stack) - 1 if searched else 0, 0, -1):
                name = stack[k][0]
                if name == "p" or name in ending:
                    for gone, _ in stack[k:]:
                        open_[gone] -= 1
                        hidden -= gone in HIDDEN
                        links -= gone == "a"
                    del stack[k:]
                    if name == "p":
                        continue
                    break
                if name in FENCES:
                    break
            if not hidden:
                parent = stack[-1][1]
                node = Node(tag, _groups(attrs), parent, len(nodes))
                parent.children.append(node)
                parent.items.append(node)
                nodes.append(node)
                stack.append((tag, node))
                open_[tag] = open_.get(tag, 0) + 1
                continue
        hidden += tag in HIDDEN
        links += tag == "a"
        stack.append((tag, stack[-1][1]))
        open_[tag] = open_.get(tag, 0) + 1
    return nodes


_OWN = 14
N_GROUPS = len(TOKENS)
WIDTH = _OWN + len(TAGS) + 2 * N_GROUPS + len(TAGS) + 8


def features(nodes: list[Node]) -> np.ndarray:
    """Subtree density, attribute words, depth, siblings and ancestors of each node."""
    n = len(nodes)
    x = np.zeros((n, WIDTH), dtype=np.float32)
    chars, linked, size, inputs, words, blocks = ([0] * n for _ in range(6))
    stops = [0] * n
    for node in reversed(nodes):
        i = node.order
        size[i] += 1
        inputs[i] += node.inputs
        own = 0
        for item in node.items:
            if type(item) is tuple:
                text = item[0].strip()
                if text:
                    own += len(text)
                    chars[i] += len(text)
                    words[i] += text.count(" ") + 1
                    stops[i] += text.count(".") + text.count(",")
                    if item[1]:
                        linked[i] += len(text)
        blocks[i] += own > 0
        if node.parent is not None:
            j = node.parent.order
            for c in (chars, linked, size, inputs, words, blocks, stops):
                c[j] += c[i]
    whole = max(1, chars[0])
    before = 0
    tag_at = {t: k for k, t in enumerate(TAGS)}
    above_tags: list[frozenset[int]] = [frozenset()] * n
    above_groups: list[frozenset[int]] = [frozenset()] * n
    position = [0] * n
    # Of each node its place among its siblings and how many share its tag; of each parent, whether a child is a comment or share part.
    place, same = [0] * n, [0] * n
    social = [False] * n
    for node in nodes:
        tags = Counter(c.tag for c in node.children)
        social[node.order] = any(7 in c.groups or 6 in c.groups for c in node.children)
        for k, c in enumerate(node.children):
            place[c.order], same[c.order] = k, tags[c.tag]
    for node in nodes:
        i = node.order
        position[i] = before
        before += sum(len(t[0]) for t in node.items if type(t) is tuple)
        p = node.parent
        if p is not None:
            above_groups[i] = above_groups[p.order] | p.groups
            above_tags[i] = above_tags[p.order] | ({tag_at[p.tag]} if p.tag in tag_at else set())
        row = x[i]
        row[0] = np.log1p(chars[i])
        row[1] = chars[i] / whole
        row[2] = linked[i] / max(1, chars[i])
        row[3] = chars[i] / size[i]
        row[4] = chars[i] / max(1, blocks[i])
        row[5] = words[i] / max(1, blocks[i])
        row[6] = stops[i] / max(1, words[i])
        row[7] = node.depth
        row[8] = len(node.children)
        row[9] = size[i]
        row[10] = inputs[i]
        row[11] = position[i] / whole
        row[12] = node.order / n
        row[13] = chars[i] / max(1, words[i])
        at = _OWN
        if node.tag in tag_at:
            row[at + tag_at[node.tag]] = 1
        at += len(TAGS)
        for g in node.groups:
            row[at + g] = 1
        at += N_GROUPS
        for g in above_groups[i]:
            row[at + g] = 1
        at += N_GROUPS
        for t in above_tags[i]:
            row[at + t] = 1
        at += len(TAGS)
        if p is not None:
            family = p.children
            row[at] = len(family)
            row[at + 1] = place[i]
            row[at + 2] = len(family) - place[i]
            row[at + 3] = chars[i] / max(1, chars[p.order])
            row[at + 4] = linked[p.order] / max(1, chars[p.order])
            row[at + 5] = chars[p.order] / max(1, blocks[p.order])
            row[at + 6] = same[i]
            row[at + 7] = social[p.order]
    return x


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """Which nodes are main: the likeliest choice in which nothing below a dropped node is kept."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    n = len(nodes)
    drop = list(no)
    keep = list(yes)
    for node in reversed(nodes[1:]):
        i, j = node.order, node.parent.order
        drop[j] += drop[i]
        keep[j] += max(keep[i], drop[i])
    chosen = [False] * n
    for node in nodes:
        up = node.parent is None or chosen[node.parent.order]
        chosen[node.order] = up and keep[node.order] > drop[node.order]
    return chosen


def block_texts(nodes: list[Node], chosen: list[bool]) -> list[str]:
    """Text runs of the chosen nodes, in page order; white space inside each is one space."""
    out: list[str] = []

    def flush(run: list[str]) -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    # Each entry: a node and how far its items are done.
    stack: list[list] = [[nodes[0], 0, []]]
    while stack:
        top = stack[-1]
        node, k, run = top
        if k == len(node.items):
            flush(run)
            stack.pop()
            continue
        top[1] += 1
        item = node.items[k]
        if type(item) is tuple:
            if chosen[node.order]:
                run.append(item[0])
        else:
            flush(run)
            if chosen[item.order]:
                stack.append([item, 0, []])
    return out
