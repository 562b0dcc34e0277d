"""HTML extraction: flat text blocks, their own and their neighbours' measures, and a decision tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page.
UNSEEN = frozenset("script style noscript template svg head title textarea select option button iframe canvas audio video map datalist annotation annotation-xml".split())
#: Elements that stand in a line of text and don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced mspace mstyle".split())
#: Elements that are kept on the stack; the rest only end blocks.
HELD = frozenset("html body nav header footer aside form article main section div ul ol dl menu table figure dialog details fieldset address blockquote".split())
#: Elements, roles and words of class or id that mark what surrounds an article.
SIDE_ELEMENTS = frozenset("nav footer aside form menu dialog".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SIDE_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs footer masthead sidebar aside widget widgets ad ads adv advert adverts advertisement adsense adbox sponsor sponsored sponsors promo promotion promoted "
    "banner cookie cookies cookiebar consent gdpr notice notices alert popup modal overlay comment comments commentlist reply replies disqus respond discussion share sharing social related recommended recommendations "
    "subscribe subscription newsletter signup login search form pagination pager toolbar skip topbar copyright legal disclaimer".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
CLOSES = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in UNSEEN}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    side: bool
    inside: bool
    heading: bool


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element begins what surrounds an article, and whether it begins an article."""
    side = tag in SIDE_ELEMENTS or tag == "header" and not in_article
    main = tag in ("article", "main")
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                found = {w.lower() for w in WORD.findall(value)}
                side = side or bool(found & SIDE_WORDS) or "header" in found and not in_article
            elif name == "role":
                side, main = side or value.lower() in SIDE_ROLES, main or value.lower() in ("main", "article")
            else:
                side = side or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()
    return side, main


def blocks(page: str | None) -> list[Block]:
    """The page's blocks of text in order, in time that grows with its length. An element that is never closed ends with the element around it."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []
    # Open elements by name, those that surround an article or begin one, and names whose end is not to come.
    held: Counter[str] = Counter()
    open_sides = open_mains = 0
    endless: set[str] = set()
    parts: list[str] = []
    state = {"linked": 0, "link": 0, "heading": False}

    def end() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            words = len(text.split(" "))
            out.append(Block(text, words, min(words, state["linked"]), open_sides > 0, open_mains > 0, state["heading"]))
        state["linked"] = 0

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state["link"]:
                state["linked"] += len(text.split())

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closes = m[2].lower(), bool(m[1])
        if tag in UNSEEN and not closes:
            end() if tag not in ("svg", "button", "annotation", "annotation-xml") else None
            if not m[3].endswith("/"):
                close = None if tag in endless else CLOSES[tag].search(page, at)
                if close:
                    at = close.end()
                elif tag not in ("head", "option"):
                    at = n
                else:
                    endless.add(tag)
            continue
        if tag == "a":
            state["link"] = 0 if closes else 1
        if tag in INLINE:
            continue
        end()
        state["heading"] = not closes and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag in HELD:
            state["link"] = 0
            if not closes:
                stack.append((tag, *_kind(tag, m[3], open_mains > 0)))
                held[tag] += 1
                open_sides, open_mains = open_sides + stack[-1][1], open_mains + stack[-1][2]
            while closes and held[tag]:
                name, side, main = stack.pop()
                held[name] -= 1
                open_sides, open_mains = open_sides - side, open_mains - main
                closes = name != tag
    end()
    return out


#: What the tree sees of a block.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "side", "place", "heading")
#: A block's place: outside the page's article, on a page without one, or inside.
OUTSIDE, NONE, INSIDE = 0, 1, 2


def features(page: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in page], float)
    density = np.array([b.linked / b.words for b in page])
    shift = lambda x, k: np.concatenate([[0.0], x[:-1]]) if k < 0 else np.concatenate([x[1:], [0.0]])
    article = any(b.inside for b in page)
    flags = np.array([(b.side, (INSIDE if b.inside else OUTSIDE) if article else NONE, b.heading) for b in page], float)
    return np.column_stack([words, density, shift(words, -1), shift(density, -1), shift(words, 1), shift(density, 1), flags])


#: The labelled table. Features in their order, then 1 for a block of the article.
LABELLED = (
    (60, 0.0, 8, 0.0, 75, 0.0, 0, 2, 0, 1), (8, 0.0, 4, 1.0, 60, 0.0, 0, 2, 1, 1), (2, 0.0, 40, 0.0, 55, 0.0, 0, 2, 0, 1), (1, 0.0, 1, 0.0, 2, 0.0, 0, 2, 0, 1), (3, 1.0, 30, 0.0, 45, 0.1, 0, 2, 0, 1), (120, 0.2, 90, 0.0, 0, 0.0, 0, 2, 0, 1),
    (25, 0.0, 3, 0.0, 6, 0.0, 0, 2, 0, 1), (12, 0.5, 35, 0.0, 20, 0.0, 0, 2, 0, 1), (4, 0.0, 100, 0.0, 9, 0.0, 0, 2, 0, 1), (70, 0.0, 0, 0.0, 0, 0.0, 0, 2, 0, 1), (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0),
    (9, 0.0, 1, 1.0, 12, 0.0, 1, 0, 0, 0), (14, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0), (45, 0.0, 80, 0.0, 30, 0.0, 1, 0, 0, 0), (30, 0.0, 60, 0.0, 60, 0.0, 1, 2, 0, 0), (50, 0.1, 70, 0.0, 4, 0.0, 1, 2, 0, 0), (3, 0.0, 30, 0.0, 40, 0.0, 1, 2, 1, 0),
    (6, 0.5, 90, 0.0, 3, 1.0, 1, 2, 0, 0), (2, 0.0, 5, 0.0, 50, 0.0, 1, 0, 1, 0), (10, 0.0, 2, 1.0, 8, 0.0, 0, 0, 0, 0), (30, 0.0, 6, 0.0, 70, 0.0, 0, 0, 0, 0), (55, 0.0, 90, 0.0, 5, 0.0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1, 0),
    (2, 1.0, 2, 1.0, 9, 0.0, 0, 0, 0, 0), (60, 0.0, 9, 0.0, 80, 0.0, 0, 1, 0, 1), (85, 0.1, 60, 0.0, 75, 0.0, 0, 1, 0, 1), (40, 0.0, 85, 0.0, 4, 0.5, 0, 1, 0, 1), (18, 0.0, 70, 0.0, 45, 0.0, 0, 1, 0, 1), (16, 0.2, 3, 0.0, 5, 0.0, 0, 1, 0, 1),
    (5, 0.0, 2, 1.0, 60, 0.0, 0, 1, 1, 1), (9, 0.0, 1, 1.0, 70, 0.0, 0, 1, 1, 1), (6, 0.0, 45, 0.0, 50, 0.0, 0, 1, 0, 1), (3, 0.0, 60, 0.0, 30, 0.0, 0, 1, 0, 1), (12, 0.0, 50, 0.0, 65, 0.0, 0, 1, 0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 1, 0, 0), (20, 0.9, 3, 1.0, 4, 1.0, 0, 1, 0, 0), (35, 0.8, 60, 0.0, 20, 0.9, 0, 1, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0, 0), (3, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0, 0), (5, 0.0, 4, 0.5, 0, 0.0, 0, 1, 0, 0),
    (2, 0.0, 1, 1.0, 3, 0.0, 0, 1, 1, 0), (6, 0.7, 5, 1.0, 2, 1.0, 0, 1, 0, 0), (22, 0.0, 70, 0.0, 4, 0.0, 1, 1, 0, 0), (30, 0.0, 2, 1.0, 2, 0.0, 0, 1, 0, 1), (18, 0.1, 24, 0.0, 2, 0.0, 0, 1, 0, 1), (22, 0.0, 3, 0.0, 1, 1.0, 0, 1, 0, 1),
    (15, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (50, 0.05, 1, 1.0, 1, 1.0, 0, 1, 0, 1), (14, 0.3, 1, 0.5, 3, 0.5, 0, 1, 0, 1), (33, 0.0, 2, 0.0, 2, 0.0, 0, 1, 0, 1), (5, 0.0, 1, 1.0, 20, 0.0, 0, 1, 1, 1), (4, 0.0, 30, 0.0, 18, 0.0, 0, 1, 0, 1),
    (5, 0.0, 22, 0.0, 1, 0.0, 0, 1, 0, 1), (3, 0.0, 5, 0.0, 2, 1.0, 0, 1, 0, 0), (13, 0.9, 2, 1.0, 40, 0.0, 0, 1, 0, 0), (4, 0.2, 1, 1.0, 1, 0.0, 0, 1, 0, 0), (2, 0.0, 4, 0.0, 0, 0.0, 0, 1, 0, 0), (11, 0.8, 50, 0.0, 3, 0.0, 0, 1, 0, 0),
    (40, 0.0, 10, 0.0, 60, 0.0, 1, 1, 0, 0), (1, 0.0, 60, 0.0, 1, 1.0, 1, 1, 0, 0), (3, 1.0, 2, 1.0, 1, 1.0, 1, 1, 0, 0), (28, 0.0, 28, 0.0, 31, 0.0, 1, 1, 0, 0), (7, 0.0, 50, 0.0, 50, 0.0, 1, 1, 1, 0), (1, 0, 0, 0, 1, 1, 0, 2, 0, 1),
    (1, 1, 1, 0, 0, 0, 0, 2, 0, 1), (2, 0.5, 2, 1, 3, 0, 0, 2, 0, 1), (4, 0, 4, 0, 0, 0, 0, 2, 0, 1), (4, 0, 0, 0, 4, 0, 0, 2, 1, 1), (6, 0, 1, 1, 2, 0, 0, 2, 1, 1), (3, 0, 9, 1, 0, 0, 0, 2, 0, 1),
    (5, 0.8, 3, 0.3, 2, 0, 0, 2, 0, 1), (9, 0, 0, 0, 0, 0, 0, 2, 0, 1), (2, 1, 1, 1, 1, 1, 0, 2, 0, 1), (7, 0.9, 2, 0, 25, 1, 0, 2, 0, 1), (3, 0, 2, 0.6, 1, 0.7, 0, 2, 0, 1), (40, 0.9, 2, 0, 3, 1, 0, 2, 0, 1),
    (1, 0, 35, 0, 0, 0, 0, 2, 0, 1), (15, 0.7, 0, 0, 1, 1, 0, 2, 0, 1), (200, 0, 1, 1, 1, 0, 0, 2, 0, 1), (90, 0, 70, 0, 60, 0, 0, 0, 0, 0), (18, 0.1, 30, 0, 40, 0, 0, 0, 0, 0), (70, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (6, 0, 25, 0, 40, 0, 0, 0, 1, 0), (120, 0.05, 2, 1, 50, 0, 0, 0, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A tree of (feature, threshold, below, above) and (verdict,): the split of least Gini impurity, the first of equals."""
    if depth == 0 or len(set(y)) == 1:
        return (bool(2 * y.sum() >= len(y)),)
    best = None
    for f in range(x.shape[1]):
        cuts = np.unique(x[:, f])
        for t in (cuts[:-1] + cuts[1:]) / 2:
            low = x[:, f] <= t
            gini = sum(len(p) * (1 - p.mean() ** 2 - (1 - p.mean()) ** 2) for p in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, t, low)
    if best is None:
        return (bool(2 * y.sum() >= len(y)),)
    _, f, t, low = best
    return (f, float(t), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def verdicts(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), bool)
    out[low], out[~low] = verdicts(tree[2], x[low]), verdicts(tree[3], x[~low])
    return out


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, good in zip(found, verdicts(tree, features(found)), strict=True) if good)


def extract(pages: DataFrame, source: str = "html", table: tuple = LABELLED) -> DataFrame:
    """pages with text, the article's blocks joined by one newline, and n_chars, its code points; such columns are replaced.

    The tree is trained on the labelled table when the query is planned. A null or empty page has an empty text; a page
    of markup that never closes is read to its end, and a very long one whole, in time that grows with its length;
    repeated pages give equal texts; an empty table gives no rows; columns but text and n_chars stay. Rows never move.
    """
    rows = np.array(table, float)
    tree = grow(rows[:, :-1], rows[:, -1].astype(int))

    @F.pandas_udf("string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x, tree) for x in s], dtype=object)

    return pages.withColumn("text", found(source)).withColumn("n_chars", F.length("text").cast("long"))


COLUMNS = ["page_id", "url", "text", "n_chars"]
