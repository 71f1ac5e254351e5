"""Labelled blocks of invented web pages, to grow and test the block tree on.

A page is put together from a layout: how its content, menus, notices, side
columns, comments and footers are marked up (or not marked at all). Every word of
main text begins with ``MARK``, so the label of a block is read off its words.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

MARK = "q"
#: How the content is enclosed, how apparatus is: by elements, by class names or by nothing.
CONTENT = ("article", "main", "div id=content", "div class=post", "td", "div", "")
APPARATUS = ("element", "name", "plain")
LAYOUTS = tuple((c, a) for c in CONTENT for a in APPARATUS if c or a != "plain")
_ELEMENT = {"menu": "nav", "top": "header", "side": "aside", "foot": "footer", "note": "dialog", "talk": "aside", "ad": "aside"}
_NAMED = {
    "menu": ("navbar", "menu", "main-nav", "breadcrumbs"),
    "top": ("masthead", "site-header", "banner"),
    "side": ("sidebar", "widget", "related-links", "side-bar"),
    "foot": ("footer", "site-footer", "legal"),
    "note": ("cookie-notice", "consent", "alert", "gdpr-banner"),
    "talk": ("comments", "user-notes", "comment-list", "replies", "discussion"),
    "ad": ("ad", "ad-box", "sponsored", "newsletter", "share-bar", "promo"),
}


class Page:
    def __init__(self, r: random.Random, content: str, apparatus: str):
        self.r, self.content, self.apparatus = r, content, apparatus

    def words(self, lo: int, hi: int, mark: str = "") -> str:
        return " ".join(mark + "".join(self.r.choice("abcdeilmnorstu") for _ in range(self.r.randint(2, 8))) for _ in range(self.r.randint(lo, hi)))

    def link(self, text: str) -> str:
        return f"<a href=/{self.r.randrange(99)}>{text}</a>"

    def links(self, n: int, lo: int = 1, hi: int = 3) -> str:
        each = [self.link(self.words(lo, hi)) for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if self.r.random() < 0.7 else "".join(f"<div>{x}</div>" for x in each)

    def region(self, kind: str, inner: str) -> str:
        """Apparatus of a kind; comments are always marked, as their text reads like any other."""
        how = self.apparatus if kind not in ("talk", "ad") or self.apparatus != "plain" else "name"
        if how == "element":
            return f"<{_ELEMENT[kind]}>{inner}</{_ELEMENT[kind]}>"
        if how == "name":
            return f'<div class="{self.r.choice(_NAMED[kind])}">{inner}</div>'
        return f"<div>{inner}</div>"

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f"<h1>{self.words(2, 10, MARK)}</h1>")
        if r.random() < 0.4:
            out.append(f"<p>{self.words(2, 6, MARK)}</p>")  # who and when
        for _ in range(r.choice((1, 2, 3, 4, 6, 9, 14))):
            kind = r.random()
            if kind < 0.45:
                text = self.words(15, 110, MARK)
                if r.random() < 0.3:
                    text += " " + self.link(self.words(1, 4, MARK)) + " " + self.words(3, 12, MARK)
                out.append(f"<p>{text}</p>")
            elif kind < 0.65:
                out.append(f"<p>{self.words(1, 14, MARK)}</p>")
            elif kind < 0.75:
                out.append(f"<h2>{self.words(1, 6, MARK)}</h2>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.words(1, 12, MARK)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.9:
                name = r.choice(("copyright-law", "teaser", "share-price", "note", "lead", "pull-quote"))
                out.append(f'<p class="{name}">{self.words(4, 60, MARK)}</p>')
            elif kind < 0.95:
                out.append(self.region("ad", self.words(2, 25) if r.random() < 0.5 else self.links(r.randint(2, 4))))
            else:
                out.append(f"<p>{self.words(4, 9, MARK)} {self.link(self.words(2, 4, MARK))}</p>")
        inner = "".join(out)
        if self.content == "td":
            return f"<table><tr><td>{self.links(4)}</td><td>{inner}</td></tr></table>"
        return f"<{self.content}>{inner}</{self.content.split(' ')[0]}>" if self.content else inner

    def html(self) -> str:
        r, out = self.r, []
        if r.random() < 0.25:  # nothing but the content
            return f"<html><body>{self.main()}" + "</body></html>" * (r.random() < 0.8)
        if r.random() < 0.5:
            out.append(self.region("note", f"<p>{self.words(6, 40)} {self.link(self.words(1, 3)) if r.random() < 0.5 else ''}</p>"))
        if r.random() < 0.7:
            out.append(self.region("top", f"<div>{self.link(self.words(1, 3))}</div><div>{self.words(2, 9)}</div>"))
        out.append(self.region("menu", self.links(r.randint(3, 10))))
        if r.random() < 0.3:
            out.append(self.region("ad", self.words(3, 14)))
        side = self.region("side", "".join(f"<h3>{self.words(1, 4)}</h3>{self.links(r.randint(2, 7), 2, 9)}" + (f"<p>{self.words(4, 25)}</p>" if r.random() < 0.4 else "") for _ in range(r.randint(1, 3))))
        before = r.random()
        if before < 0.3:
            out.append(side)
        out.append(self.main())
        if r.random() < 0.4:
            talk = "".join(f"<div><div>{self.words(1, 3)}</div><p>{self.words(3, 60)}</p></div>" for _ in range(r.randint(1, 6)))
            out.append(self.region("talk", f"<h3>{self.words(1, 2)}</h3>{talk}"))
        if 0.3 < before < 0.8:
            out.append(side)
        if r.random() < 0.85:
            out.append(self.region("foot", (self.links(r.randint(2, 5)) if r.random() < 0.6 else "") + f"<div>&copy; {self.words(2, 14)}</div>"))
        if r.random() < 0.3:
            out.append(self.region("note", f"<div>{self.words(8, 35)}</div>"))
        return "<html><head><title>x</title></head><body>" + "".join(out) + "</body></html>"


def pages(seed: int, each: int, layouts=LAYOUTS) -> Iterator[str]:
    """``each`` pages of every layout, and as many that are nothing but a few short blocks."""
    r = random.Random(seed)
    for content, apparatus in layouts:
        for _ in range(each):
            yield Page(r, content, apparatus).html()
        p = Page(r, content, apparatus)
        yield "".join(f"<p>{p.words(1, 5, MARK)}</p>" for _ in range(r.randint(1, 4)))


def is_main(text: str) -> bool:
    """The label of a block: whether most of its words are main text."""
    words = text.split(" ")
    return 2 * sum(w.startswith(MARK) for w in words) > len(words)
