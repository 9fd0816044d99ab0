"""Made-up pages with known main text, to train and test extraction.  Bounded by their number.

Layouts, names, markup faults and text are drawn at random from what is common on the
web: one column, two columns, documentation with a table of contents, portals with
teasers, and layout by tables.
"""

from __future__ import annotations

import random
from html import escape

#: Class and id names that pages use for each part.
NAMES = {
    "nav": ("nav", "navbar", "menu", "main-menu", "navigation", "topnav", "site-nav", "breadcrumbs"),
    "header": ("header", "masthead", "site-header", "topbar", "branding"),
    "footer": ("footer", "site-footer", "foot", "colophon", "copyright", "page-bottom"),
    "side": ("sidebar", "side", "widget", "related", "related-posts", "right-rail", "trending", "popular-posts", "recommended"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "ad-banner", "sponsor-box"),
    "notice": ("cookie", "cookie-notice", "notice", "alert", "gdpr-consent", "modal", "popup", "site-message", "disclaimer"),
    "comment": ("comments", "comment-list", "comment", "discussion", "replies", "reader-comments", "responses", "disqus-thread"),
    "share": ("share", "social", "social-links", "share-buttons", "post-tags", "meta-tools"),
    "form": ("search", "newsletter", "subscribe", "signup-form", "login", "contact-form"),
    "main": ("article", "content", "main-content", "post", "post-body", "entry-content", "story", "article-body", "page-text", "text", ""),
}


class _Maker:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.parts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüß") for _ in range(rng.randint(1, 4))) for _ in range(60)]
        self.noise = "" if rng.random() < 0.6 else rng.choice("!?*#~=+|&^$%") * rng.randint(1, 4)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        words = ["".join(r.choice(self.parts) for _ in range(r.choice((1, 1, 2, 2, 3)))) for _ in range(r.randint(low, high))]
        for k in range(len(words)):
            if r.random() < 0.12:
                words[k] += r.choice(",.")
            if self.noise and r.random() < 0.5:
                words[k] += self.noise
        return " ".join(words).capitalize() + r.choice((".", ".", "", "!"))

    def name(self, part: str) -> str:
        r = self.rng
        value = r.choice(NAMES[part])
        if not value or r.random() < 0.12:
            return ""
        return f' {r.choice(("class", "class", "id", "role" if part in ("nav", "main") else "class"))}="{value}"'

    def links(self, part: str) -> str:
        r = self.rng
        some = [f'<a href="/{k}">{escape(self.words(1, 3))}</a>' for k in range(r.randint(2, 9))]
        if r.random() < 0.7:
            some = [f"<li>{s}</li>" if r.random() < 0.9 else f"<li>{s}" for s in some]
            return f"<ul{self.name(part) if r.random() < 0.3 else ''}>{''.join(some)}</ul>"
        return r.choice((" ", " | ", "")).join(some)

    def part(self, kind: str) -> str:
        """One part that isn't main text."""
        r = self.rng
        tag = {"nav": ("nav", "nav", "div"), "header": ("header", "div"), "footer": ("footer", "footer", "div"), "side": ("aside", "div"), "ad": ("div", "div", "aside", "ins", "section"), "notice": ("div", "section", "dialog"), "comment": ("section", "div", "ol"), "share": ("div", "ul", "p"), "form": ("form", "form", "div")}[kind]
        tag = r.choice(tag)
        plain = tag in ("div", "section", "ol", "ins", "p", "ul")
        name = self.name(kind)
        while plain and not name:
            name = self.name(kind)
        if kind == "nav":
            body = self.links(kind)
        elif kind == "header":
            body = f"<a href='/'>{escape(self.words(1, 3))}</a>" + (self.part("nav") if r.random() < 0.5 else "") + (f"<p>{escape(self.words(3, 9))}</p>" if r.random() < 0.4 else "")
        elif kind == "footer":
            body = f"&copy; {escape(self.words(2, 25))}" + (self.links(kind) if r.random() < 0.5 else "") + (f"<p>{escape(self.words(5, 30))}</p>" if r.random() < 0.4 else "")
        elif kind == "side":
            body = (f"<h3>{escape(self.words(1, 4))}</h3>" if r.random() < 0.7 else "") + (self.links(kind) if r.random() < 0.6 else "".join(f"<p>{escape(self.words(5, 40))}</p>" for _ in range(r.randint(1, 3))))
        elif kind == "ad":
            body = r.choice((escape(self.words(3, 30)), f"<p>{escape(self.words(3, 40))}</p>", f'<a href="/b">{escape(self.words(2, 12))}</a>'))
        elif kind == "notice":
            body = f"<p>{escape(self.words(6, 40))}</p><button>{escape(self.words(1, 2))}</button>" if r.random() < 0.6 else escape(self.words(5, 40))
        elif kind == "comment":
            inner = "".join(
                f"<{t}{self.name(kind)}><p>{escape(self.words(4, 70))}</p></{t}>" if r.random() < 0.6 else f"<p>{escape(self.words(4, 60))}</p>" if tag != "ol" else f"<li>{escape(self.words(4, 60))}</li>"
                for t in [("li" if tag == "ol" else r.choice(("div", "article", "div")))] * r.randint(1, 6)
            )
            body = (f"<h3>{escape(self.words(1, 4))}</h3>" if tag != "ol" else "") + inner + (self.part("form") if r.random() < 0.3 and tag != "ol" else "")
        elif kind == "share":
            body = "".join(f'<a href="/s">{escape(self.words(1, 2))}</a> ' for _ in range(r.randint(2, 5)))
            body = f"<li>{body}</li>" if tag == "ul" else body
        else:
            body = f"<label>{escape(self.words(1, 6))}</label><input name=q><button>{escape(self.words(1, 2))}</button>"
        return f"<{tag}{name}>{body}</{tag}>"

    def main(self, wide: bool = False) -> tuple[str, list[str]]:
        """Markup of the main text, and its blocks; wide: 64 to 200 of them side by side."""
        r = self.rng
        blocks: list[str] = []

        def text(low: int, high: int) -> str:
            value = self.words(low, high)
            blocks.append(" ".join(value.split()))
            shown = escape(value)
            if r.random() < 0.2:
                cut = shown.find(" ")
                if cut > 0 and "&" not in shown[:cut]:
                    shown = f"<b>{shown[:cut]}</b>{shown[cut:]}" if r.random() < 0.5 else f'<a href="/r">{shown[:cut]}</a>{shown[cut:]}'
            return shown.replace(" ", "\n  ", 1) if r.random() < 0.1 else shown

        out = []
        if r.random() < 0.85:
            head = f"<h1>{text(2, 14)}</h1>"
            out.append(f"<header>{head}</header>" if r.random() < 0.15 else head)
        long = r.random()
        for _ in range(r.randint(64, 200) if wide else 1 if long < 0.15 else r.randint(2, 14)):
            k = r.random()
            if k < 0.72:
                size = (1, 6) if r.random() < 0.15 else (8, 90)
                out.append(f"<p>{text(*size)}" + ("</p>" if r.random() < 0.85 else ""))
            elif k < 0.78:
                # An inline element that isn't closed, and line breaks.
                t = r.choice(("b", "i", "em", "strong", "span", "font"))
                out.append(f"<p><{t}>{text(3, 40)}" + r.choice(("<br>", "<br/>", "<br><br>", "")) + r.choice(("</p>", "")))
            elif k < 0.84:
                t = r.choice(("h2", "h2", "h3", "h4"))
                out.append(f"<{t}>{text(2, 8)}</{t}>")
            elif k < 0.9:
                t = r.choice(("ul", "ol"))
                out.append(f"<{t}>{''.join(f'<li>{text(2, 25)}</li>' for _ in range(r.randint(2, 5)))}</{t}>")
            elif k < 0.94:
                out.append(f"<blockquote><p>{text(8, 40)}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{text(8, 40)}</blockquote>")
            elif k < 0.96:
                out.append(f"<figure><img src=a.png><figcaption>{text(3, 12)}</figcaption></figure>")
            elif k < 0.98:
                out.append(f"<table><tr><td>{text(1, 4)}</td><td>{text(1, 4)}</td></tr></table>")
            else:
                out.append(f"<pre>{text(4, 20)}</pre>")
            if r.random() < 0.06:
                out.append(self.part(r.choice(("ad", "share", "side", "form", "notice"))))
        return "".join(out), blocks


def _head(m: _Maker) -> str:
    r = m.rng
    rules = " ".join(f"{r.choice(('body', '.a', '#x', 'h1', 'ul li', 'p'))} {{ {r.choice(('color', 'margin', 'font-size', 'display'))}: {r.choice(('0', '1em', 'none', '#333'))} }}" for _ in range(r.randint(0, 4)))
    scripts = (f"var x{r.randint(0, 99)} = '<div>' + y + '</div>';", "if (a < b && c > d) { load(); }", '{"@type": "NewsArticle", "headline": "x"}', "document.write('<p>' + t)", "/* <li> */ go();")
    parts = [f"<title>{escape(m.words(2, 8))}</title>"]
    if rules:
        parts.append(f"<style>{rules}</style>")
    parts += [f"<script{r.choice(('', ' async', ' type=module'))}>{r.choice(scripts)}</script>" for _ in range(r.choice((0, 1, 1, 2)))]
    parts += [r.choice(('<meta name="viewport" content="width=device-width">', '<link rel="stylesheet" href="/s.css">', "<meta charset=utf-8>")) for _ in range(r.randint(0, 3))]
    r.shuffle(parts)
    return f"<head>{''.join(parts)}</head>"


def _laid_out(m: _Maker, core: str) -> str:
    """The main text among the other parts, in one of several layouts."""
    r = m.rng

    def some(*kinds: tuple[str, float]) -> str:
        return "".join(m.part(k) for k, c in kinds if r.random() < c)

    top = some(("notice", 0.25), ("header", 0.45), ("nav", 0.7), ("form", 0.15), ("ad", 0.5))
    end = some(("comment", 0.3), ("side", 0.3), ("ad", 0.25), ("form", 0.2), ("notice", 0.1), ("footer", 0.85))
    layout = r.choice(("column", "column", "column", "columns", "docs", "portal", "table"))
    if layout == "columns":
        side = f"<div class='{r.choice(('side', 'sidebar', 'right-rail', 'col side'))}'>{some(('side', 0.9), ('ad', 0.5), ('form', 0.3), ('nav', 0.2))}</div>"
        both = [f"<div class='{r.choice(('left', 'col', 'main-col', 'content'))}'>{core}</div>", side]
        core = f"<div class={r.choice(('row', 'wrap', 'grid'))}>{''.join(both if r.random() < 0.7 else both[::-1])}</div>"
    elif layout == "docs":
        toc = f"<nav class='{r.choice(('toc', 'menu', 'sidebar'))}'>{m.links('nav')}</nav>"
        core = f"<div class={r.choice(('layout', 'docs', 'container'))}>{toc}{core}</div>" + (f"<div class=pager>{m.links('nav')}</div>" if r.random() < 0.5 else "")
    elif layout == "portal":
        teasers = "".join(f"<div class='{r.choice(('related', 'trending', 'more', 'popular'))}'><h3>{escape(m.words(1, 3))}</h3><p><a href='/t{k}'>{escape(m.words(3, 12))}</a></p></div>" for k in range(r.randint(1, 4)))
        core = core + f"<section class='{r.choice(('recommended', 'related', 'popular'))}'>{teasers}</section>"
    elif layout == "table":
        core = f"<table width=100%><tr><td class={r.choice(('menu', 'nav', 'side'))}>{m.links('nav')}</td><td>{core}</td></tr></table>"
    return top + core + end


def page(seed: int, wide: bool = False) -> tuple[str, list[str]]:
    """(html, blocks of main text) of one made-up page; wide: its main text is a long flat list of blocks."""
    r = random.Random(seed)
    m = _Maker(r)
    body, blocks = m.main(wide)
    tag = r.choice(("article", "article", "main", "div", "section"))
    name = m.name("main")
    while tag in ("div", "section") and not name:
        name = m.name("main")
    inside = r.random() < 0.4
    tail = "".join(m.part(k) for k in ("share", "comment") if r.random() < 0.35) if inside else ""
    core = f"<{tag}{name}>{body}{tail}</{tag}>"
    for _ in range(r.choice((0, 0, 1, 1, 2))):
        core = f"<div{r.choice(('', m.name('main')))}>{core}{m.part('side') if r.random() < 0.2 else ''}</div>"
    start = r.choice(("<!DOCTYPE html>", "<!doctype html>\n", "")) + r.choice(("<html>", '<html lang="en">', "<html>\n"))
    return f"{start}{_head(m)}<body{r.choice(('', ' class=page'))}>{_laid_out(m, core)}" + ("</body></html>" if r.random() < 0.9 else ""), blocks
