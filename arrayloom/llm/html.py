"""Main text of web pages by shallow block features and a decision tree.

A page is read as a flat list of text blocks. Each block has its word count
and link density, those of its neighbours, how far long plain blocks are on
either side, and what encloses it: an element or a class name that tells of
apparatus, a content element, and the core, the smallest element that holds most of
the page's long plain text. A decision tree, grown on the labelled blocks of
``layouts`` (TRAINING_PAGES pages of each layout, a fixed number), says which
blocks are main text. A block between two blocks of main text is main text
too, unless it is a link or enclosed as apparatus.

Hidden elements, scripts, styles and form controls are no blocks at all.

Defined cases: null or empty html gives an empty text; tags cut off at the end
and unclosed elements are closed by what follows; repeated rows are each
extracted; ids and urls may be null; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm import layouts

FEATURES = (
    "words", "words_before", "words_after", "links", "links_before", "links_after", "long_before", "long_after",
    "in_content", "has_content", "in_apparatus", "in_core", "heading", "core_words",
)
#: Pages of each layout that the tree is grown on.
TRAINING_PAGES, TRAINING_SEED = 20, 7
#: Words and link density of a long plain block; the share of their words that the core holds.
LONG, PLAIN, CORE = 12, 0.34, 0.67


class DecisionTree:
    """CART on a small table by Gini impurity; ties go to the first feature and the smallest cut."""

    def __init__(self, rows, depth: int = 9, least: int = 4):
        t = np.asarray(rows, dtype=float)
        self.root = self._grow(t[:, :-1], t[:, -1].astype(int), depth, least)

    def _grow(self, x, y, depth, least):
        vote = int(2 * y.sum() >= len(y))
        if depth == 0 or len(set(y.tolist())) < 2:
            return vote
        best = None
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, ones = x[order, k], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows on the left of each cut
            at = at[(at >= least) & (len(y) - at >= least)]
            if not len(at):
                continue
            left, right, n = ones[at - 1], ones[-1] - ones[at - 1], len(y) - at
            gini = 2 * (left * (at - left) / at + right * (n - right) / n)
            i = int(np.argmin(gini))
            if best is None or gini[i] < best[0] - 1e-9:
                best = (float(gini[i]), k, float(v[at[i] - 1] + v[at[i]]) / 2)
        if best is None:
            return vote
        _, k, cut = best
        left = x[:, k] <= cut
        return k, cut, self._grow(x[left], y[left], depth - 1, least), self._grow(x[~left], y[~left], depth - 1, least)

    def predict(self, row) -> int:
        node = self.root
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|iframe|svg|title)\b.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_APPARATUS = frozenset("nav footer aside form menu dialog button fieldset".split())
_CONTENT = frozenset("article main".split())
#: Parts of class names that tell of apparatus, and parts that say nothing.
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead banner ad ads advert adverts advertisement "
    "advertising sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup login comment comments reply replies respond responses discussion disqus share sharing social "
    "related recommended recommendations widget toolbar pagination pager copyright legal disclaimer outbrain taboola "
    "contentinfo complementary search dialog tablist menubar skip notes".split()
)
_NEUTRAL = frozenset(
    "box wrap wrapper container list block item items inner outer area section content text bar links link left right top bottom main site page "
    "row col column group panel header user reader top bottom slot unit form button title body the js".split()
)
_PART = re.compile(r"[a-z]+")
#: Elements whose names say nothing about what they hold.
_UNFLAGGED = frozenset("html body main".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _enclosed_as(tag: str, attributes: str, in_content: bool) -> tuple[bool, bool]:
    """Whether an element is apparatus by its tag, role or names, and whether it is hidden."""
    apparatus = tag in _APPARATUS or (tag == "header" and not in_content)
    if not attributes or tag in _UNFLAGGED:
        return apparatus, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = max(values).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return True, True
        if name in ("class", "id", "role"):
            for one in value.split():
                parts = set(_PART.findall(re.sub(r"side-?bar", "sidebar", one)))
                known = parts & _NAMES
                if tag == "article":
                    known &= {"comment", "comments", "reply", "replies"}
                # every part must be known: "copyright-law" is a subject, "ad-box" an advert
                if known and parts <= _NAMES | _NEUTRAL:
                    apparatus = True
                if not in_content and tag != "article" and "header" in parts and parts <= _NEUTRAL:
                    apparatus = True
    return apparatus, False


def blocks(html: str) -> list[tuple[str, list]]:
    """(text, features) of the text blocks in page order."""
    found: list[list] = []  # text, words, link density, in content, in apparatus, heading, element
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, in content, in apparatus, hidden, element
    parent = [0]  # of every element; 0 is the page
    links, heading, at = 0, False, 0
    state = (False, False, False, 0)

    def close() -> None:
        nonlocal parts
        if parts:
            text = " ".join(unescape("".join(p for p, _ in parts)).split())
            if text and not state[2]:
                n = text.count(" ") + 1
                linked = sum(len(unescape(p).split()) for p, inside in parts if inside)
                found.append([text, n, min(1.0, linked / n), state[0], state[1], heading, state[3]])
            parts = []

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append((html[at : m.start()], links > 0))
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and m[1].lower() == "title":
                close()
            continue
        tag, ends = tag.lower(), bool(m[2])
        if tag in _INLINE:
            if tag == "a":
                links = max(0, links - 1) if ends else 1
            continue
        if tag == "br":
            parts.append((" ", links > 0))
            continue
        close()
        if tag in _VOID:
            continue
        links = 0
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if tag == "p" and stack and stack[-1][0] == "p":  # a paragraph ends where the next begins
                stack.pop()
            _, content, apparatus, hidden, up = stack[-1] if stack else ("", False, False, False, 0)
            own, hides = _enclosed_as(tag, m[4], content)
            parent.append(up)
            stack.append((tag, content or tag in _CONTENT, apparatus or own, hidden or hides, len(parent) - 1))
        state = stack[-1][1:] if stack else (False, False, False, 0)
        heading = bool(stack) and stack[-1][0] in _HEADINGS
    if at < len(html):
        parts.append((html[at:], links > 0))
    close()
    return _with_features(found, parent)


def _with_features(found: list[list], parent: list[int]) -> list[tuple[str, list]]:
    has = any(b[3] and not b[4] for b in found)
    plain = [b[1] >= LONG and b[2] < PLAIN and not b[4] and b[3] >= has for b in found]
    # the words of long plain blocks in every element; elements come after their parents
    weight = [0] * len(parent)
    for b, is_plain in zip(found, plain, strict=True):
        weight[parent[b[6]]] += b[1] * is_plain  # a paragraph is no core of its own
    for e in range(len(parent) - 1, 0, -1):
        weight[parent[e]] += weight[e]
    core = max((e for e in range(len(parent)) if weight[e] >= CORE * weight[0]), default=0) if weight[0] else 0
    in_core = [e == core for e in range(len(parent))]
    for e in range(1, len(parent)):
        in_core[e] = in_core[e] or in_core[parent[e]]
    n, far = len(found), 9
    before, after = [far] * n, [far] * n
    for k in range(1, n):
        before[k] = 1 if plain[k - 1] else min(far, before[k - 1] + 1)
    for k in range(n - 2, -1, -1):
        after[k] = 1 if plain[k + 1] else min(far, after[k + 1] + 1)
    none = ("", 0, 0.0)
    out = []
    for k, b in enumerate(found):
        x, y = found[k - 1] if k else none, found[k + 1] if k + 1 < n else none
        row = [b[1], x[1], y[1], b[2], x[2], y[2], before[k], after[k], int(b[3]), int(has), int(b[4]), int(in_core[b[6]] and b[3] >= has), int(b[5]), min(weight[core], 4 * LONG)]
        out.append((b[0], row))
    return out


@lru_cache
def training(seed: int = TRAINING_SEED, each: int = TRAINING_PAGES, kinds: tuple = layouts.LAYOUTS) -> list[tuple]:
    """Labelled blocks: FEATURES, then 1 for main text."""
    return [(*row, int(layouts.is_main(text))) for page in layouts.pages(seed, each, kinds) for text, row in blocks(page)]


@lru_cache
def default_tree() -> DecisionTree:
    return DecisionTree(training())


def is_main(rows: list[list], tree: DecisionTree) -> list[bool]:
    """The verdict on the blocks of a page."""
    said = [bool(tree.predict(r)) for r in rows]
    link, flagged = FEATURES.index("links"), FEATURES.index("in_apparatus")
    inside, last = said[:], None
    for k, main in enumerate(said):
        if main:
            gap = range(last + 1, k) if last is not None else ()
            if not any(rows[j][flagged] for j in gap):  # apparatus ends a run
                for j in gap:
                    inside[j] = rows[j][link] < PLAIN
            last = k
    return inside


def main_text(html: str | None, tree: DecisionTree) -> str:
    found = blocks(html or "")
    return " ".join(text for (text, _), main in zip(found, is_main([r for _, r in found], tree), strict=True) if main)


def extract(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; one narrow pass."""
    tree = default_tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("page_id"), F.col(f"`{url_column}`").cast("string").alias("url"), F.col(f"`{html_column}`").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
