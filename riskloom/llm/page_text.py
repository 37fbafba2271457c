"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks where block-level tags stand. A block is described by its number of
words and its link density, the same of the blocks before and after it, and where it lies:
inside an article, inside navigation or another frame of the page, or under a name that frames
have. A tree grown from a small labelled table says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fresh, map_batches
from riskloom.llm.page_table import PAGES

# Tags by what they do.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("script style noscript template svg math iframe object select button textarea option head title canvas audio video".split())
FRAMES = frozenset("nav footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side "
    "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices "
    "alert gdpr popup modal newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations comment comments disqus replies reply respond widget widgets toolbar pagination pager login "
    "search copyright legal disclaimer outbrain taboola teaser".split()
)

# What comes beside a frame's name in a class or id, as in site-footer or ad-slot.
PLACES = frozenset(
    "area article bar block body bottom box button col column container content entry form group head header inner item items "
    "left link links list main nav page panel post right row section site slot space text title top unit wrap wrapper zone".split()
)

# A tag ends at the next > outside of quotes that follow an equals sign, or with the page. Nothing is tried twice,
# so many tags without an end are one.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|</?\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*+(?:display\s*+:\s*+none|visibility\s*+:\s*+hidden)", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int  # words inside links
    article: bool
    frame: bool


def _named(value: str) -> bool:
    """Whether one of the names is that of a frame: by itself, or with nothing but words for places beside it."""
    for name in value.lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not NAMES.isdisjoint(words) and all(w in NAMES or w in PLACES for w in words):
            return True
    return False


def _framed(tag: str, attributes: str, inside: bool) -> bool:
    if tag in FRAMES or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    has: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        has.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if has.get("hidden", "false").lower() != "false" or has.get("aria-hidden", "").lower() == "true":
        return True
    if _NO_DISPLAY.search(has.get("style", "")):
        return True
    return tag not in ("article", "main") and any(_named(has.get(k, "")) for k in ("class", "id", "role"))


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks in page order; none is empty. Unclosed tags, cut tags and cut pages are taken
    as far as they go. Time grows with the page's length, whatever is in it."""
    page, out = page or "", []
    parts: list[str] = []
    state = {"linked": 0, "link": 0}
    # Open block tags with (tag, inside an article, inside a frame).
    open_: list[tuple[str, bool, bool]] = [("", False, False)]
    depth: Counter = Counter()  # open tags by name
    unclosed: set[str] = set()  # dropped tags that nothing closes from here on

    def put(raw: str) -> None:
        value = html.unescape(raw)
        parts.append(value)
        if state["link"]:
            state["linked"] += len(value.split())

    def end() -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(len(words), state["linked"]), *open_[-1][1:]))
            parts.clear()
        state["linked"] = 0

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in DROPPED and not closing:
            if not m[3].endswith("/"):
                stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
                # A head that is not closed ends where the body starts.
                if not stop and tag in ("head", "option", "title"):
                    unclosed.add(tag)
                    continue
                at = stop.end() if stop else len(page)
            if tag in BLOCKS:
                end()
        elif tag == "a":
            state["link"] = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            end()
            state["link"] = 0
            if closing:
                while depth[tag]:
                    last = open_.pop()[0]
                    depth[last] -= 1
                    if last == tag:
                        break
            elif tag not in VOID:
                if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and open_[-1][0] in ("p", tag):
                    depth[open_.pop()[0]] -= 1
                depth[tag] += 1
                _, article, frame = open_[-1]
                open_.append((tag, article or tag in ("article", "main"), frame or _framed(tag, m[3], article)))
    put(page[at:])
    end()
    return out


def describe(blocks: list[Block]) -> np.ndarray:
    """One row per block: words and link density of itself, the one before and the one after,
    article, frame. Beyond the page's ends lie blocks without words."""
    words = np.array([0, *(b.words for b in blocks), 0], float)
    density = np.array([0.0, *(b.linked / b.words for b in blocks), 0.0])
    own = slice(1, -1)
    return np.column_stack(
        [
            words[own], density[own], words[:-2], density[:-2], words[2:], density[2:],
            [b.article for b in blocks], [b.frame for b in blocks],
        ]
    )


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """A decision tree by Gini impurity; ties go to the first feature and lowest cut."""
    node, n = Node(float(y.mean()) if len(y) else 0.0), len(y)
    if depth == 0 or n < 2 * least or node.share in (0.0, 1.0):
        return node
    best = n * node.share * (1 - node.share) - 1e-9
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value, hit = x[order, f], np.cumsum(y[order])
        for i in range(least, n - least + 1):
            if value[i - 1] < value[i]:
                left = hit[i - 1]
                right = hit[-1] - left
                impurity = left * (1 - left / i) + right * (1 - right / (n - i))
                if impurity < best:
                    best, node.feature, node.cut = impurity, f, (value[i - 1] + value[i]) / 2
    if node.feature >= 0:
        low = x[:, node.feature] < node.cut
        node.low, node.high = grow_tree(x[low], y[low], depth - 1, least), grow_tree(x[~low], y[~low], depth - 1, least)
    return node


def decide(node: Node, row: np.ndarray) -> bool:
    while node.low is not None:
        node = node.low if row[node.feature] < node.cut else node.high
    return node.share >= 0.5


def labelled_blocks(pages: tuple[str, ...] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table's blocks, whose texts start with + (main text) or -."""
    x, y = [], []
    for page in pages:
        blocks = blocks_of(page)
        for b in blocks:
            y.append(b.text[0] == "+")
            b.words = max(1, b.words - 1)
            b.linked = min(b.linked, b.words)
        x.append(describe(blocks))
    return np.concatenate(x), np.array(y, float)


@lru_cache(maxsize=1)
def _tree() -> Node:
    return grow_tree(*labelled_blocks())


def main_text(page: str | None) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    rows = describe(blocks)
    return "\n".join(b.text for b, row in zip(blocks, rows) if decide(_tree(), row))


def extract_pages(df: DataFrame, page: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` with ``text``: main text blocks, one a line. Null and empty pages, and pages
    without main text, have an empty text; repeated rows come as often as they are, no rows give none. Pages are taken whole;
    nothing is shuffled."""
    at = fresh(df, "__page")
    source = df.select(*keep, F.col(page).alias(at))

    def rows(batch):
        return {"text": [main_text(p) for p in batch[at]]}

    return map_batches(source, "text string", rows, keep)
