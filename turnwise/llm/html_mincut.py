"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into text blocks with their place in the document tree. A linear classifier gives each block a cost for
being called boilerplate and one for being called content; they are its capacities from the source and to the sink.
Blocks that follow each other, or are near in the tree, are joined by edges that cost something if the two are called
differently. A maximum flow finds the labelling of least cost: the blocks still reached from the source are the content.
No labelled pages are given, so the classifier's weights are fixed and stand here.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from turnwise.llm.arrow_text import text_slices

# Element names and words of class, id and role attributes.
SILENT = set("script style noscript template head title svg annotation iframe object canvas audio video select option datalist textarea button".split())
RAW = set("script style textarea title noscript iframe template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot "
    "thead tr ul caption".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
AWAY = set("nav footer aside form menu dialog fieldset".split())
WITHIN = set("article main".split())
AWAY_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsors sponsored promo promos "
    "promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer foot "
    "header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social follow related recommended recommendations trending comment "
    "comments disqus respond reply replies pagination pager search form forms copyright legal disclaimer tags tagcloud "
    "complementary contentinfo dialog skip hidden".split()
)
WITHIN_WORDS = set("article articles content post entry story main text prose".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
STOPS_AT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {name: re.compile("</" + name, re.IGNORECASE | re.ASCII) for name in RAW}


@dataclass(frozen=True)
class CutWeights:
    bias: float = -0.2
    away: float = -10.0  # an element such as nav, footer or form around the block
    away_word: float = -9.0  # a class, id or role that says so
    within: float = 4.0  # inside article or main
    within_word: float = 2.0
    paragraph: float = 0.8
    heading: float = 0.4
    words: float = 0.08  # for every word, up to 25
    sentence: float = 0.6  # ends like a sentence
    links: float = -3.0  # times the share of linked characters
    same_parent: float = 0.8  # smoothness between neighbours under one element
    near: float = 0.4  # under one grandparent
    next: float = 0.2  # merely next to each other


COMMENT_WORDS = set("comment comments disqus respond reply replies".split())
DOUBTFUL = set("form fieldset".split())  # some pages are one form


@dataclass
class Element:
    """``signs`` are its own: against content by its name, by a word, and whether these hold however much is in it."""

    name: str
    parent: Element | None
    within: int = 0  # signs for content on the way to the root
    within_words: int = 0
    silent: bool = False
    signs: tuple[int, int, bool] = (0, 0, True)
    away: int = 0  # signs against content on the way to the root, once the page is read
    away_words: int = 0
    prose: int = 0  # characters outside links in it
    holds: bool = False  # an article or main element, itself or below it


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    element: Element | None = None
    linked: int = 0
    text: str = ""


def _child(parent: Element, name: str, attributes: str) -> Element:
    e = Element(name, parent, parent.within, parent.within_words, parent.silent or name in SILENT)
    away, away_words, certain = 0, 0, name not in DOUBTFUL
    if name in AWAY or (name == "header" and not parent.within):
        away += 1
    elif name in WITHIN:
        e.within += 1
        e.holds = True
    if attributes and "=" in attributes or "hidden" in attributes:
        for key, a, b, c, bare in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if bare or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                away, certain = away + 1, True
            elif key in ("class", "id", "role") and name not in ("html", "body"):
                words = {w.lower() for w in WORD.findall(value)}
                if e.within:
                    words -= {"header"}  # an article's own head holds its title
                if words & AWAY_WORDS:
                    away_words += 1
                    certain = certain and (name in AWAY or bool(words & COMMENT_WORDS))
                elif words & WITHIN_WORDS:
                    e.within_words += 1
    e.signs = (away, away_words, certain)
    return e


def _weigh_signs(elements: list[Element], blocks: list[Block]) -> None:
    """Adds up the signs against content from the root down. A doubtful one - a form, a word of a class - is void for an
    element that holds the article and more than half of the page's prose: the page would lose its text by it."""
    for b in blocks:
        b.element.prose += len(b.text) - min(b.linked, len(b.text))
    total = sum(b.element.prose for b in {id(b.element): b for b in blocks}.values())
    for e in reversed(elements):  # children stand behind their parents
        if e.parent is not None:
            e.parent.prose += e.prose
            e.parent.holds |= e.holds
    for e in elements:
        away, words, certain = e.signs
        if not certain and e.holds and 2 * e.prose > total:
            away = words = 0
        if e.parent is not None:
            away, words = away + e.parent.away, words + e.parent.away_words
        e.away, e.away_words = away, words


def page_blocks(page: str) -> list[Block]:
    """Blocks with text in page order. Unclosed, stray and wrongly nested tags are taken as browsers would."""
    current = Element("", None)
    elements = [current]
    blocks: list[Block] = []
    block = Block()
    links = 0
    position, end = 0, len(page)

    def text(piece: str) -> None:
        nonlocal block
        if current.silent or not piece:
            return
        piece = html.unescape(piece) if "&" in piece else piece
        if links:
            block.linked += len(piece.strip())
        if block.element is None and piece.strip():
            block.element = current
        block.parts.append(piece)

    def flush() -> None:
        nonlocal block
        if block.element is not None:
            blocks.append(block)
        block = Block()

    while position < end:
        at = page.find("<", position)
        if at < 0:
            text(page[position:])
            break
        tag = TAG.match(page, at)
        if tag is None:  # a lone sign
            text(page[position : at + 1])
            position = at + 1
            continue
        text(page[position:at])
        position = tag.end()
        name = tag.group(2)
        if name is None:
            continue
        name = name.lower()
        if tag.group(1):
            if name in BLOCK:
                flush()
            if name == "a" and links:
                links -= 1
            walk = current
            while walk.parent is not None and walk.name != name:
                walk = walk.parent
            if walk.parent is not None:
                current = walk.parent
            elif name == "br":
                text(" ")
            continue
        if name == "br" or name in ("td", "th"):
            text(" ")
        if name in BLOCK:
            flush()
            walk = current  # a block closes a paragraph that is still open
            while walk.parent is not None and walk.name not in BLOCK:
                walk = walk.parent
            if walk.name == "p" or walk.name in HEADINGS and name in HEADINGS:
                current = walk.parent
        if name in CLOSED_BY:
            walk = current
            while walk.parent is not None and walk.name not in CLOSED_BY[name] and walk.name not in STOPS_AT.get(name, ()):
                walk = walk.parent
            if walk.name in CLOSED_BY[name]:
                current = walk.parent
        if name in VOID:
            continue
        if name == "a":
            links += 1
        closed = tag.group(3).endswith("/") and name not in BLOCK and name != "a"
        if name in RAW:  # its content is not markup
            closing = RAW_END[name].search(page, position)
            position = end if closing is None else max(page.find(">", closing.start()) + 1, closing.start() + 2)
            continue
        if not closed:
            current = _child(current, name, tag.group(3))
            elements.append(current)
    flush()
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    blocks = [b for b in blocks if b.text]
    _weigh_signs(elements, blocks)
    return blocks


def block_score(block: Block, w: CutWeights) -> float:
    """Positive for content: the classifier's margin, the cost of calling the block what it does not look like."""
    e = block.element
    words = block.text.count(" ") + 1
    score = w.bias + w.words * min(words, 25) + w.links * min(1.0, block.linked / len(block.text))
    if e.within:
        score += w.within
    elif e.within_words:
        score += w.within_word
    if e.away:
        score += w.away
    if e.away_words:
        score += w.away_word
    walk = e
    while walk.parent is not None and walk.name not in BLOCK:
        walk = walk.parent
    if walk.name == "p":
        score += w.paragraph
    elif walk.name in HEADINGS:
        score += w.heading
    if block.text[-1] in ".!?…\"”":
        score += w.sentence
    return score


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source. A positive score is the capacity from the source, a negative one to the sink."""
    excess = list(scores)
    target: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in scores]
    for a, b, weight in edges:
        out[a].append(len(target))
        out[b].append(len(target) + 1)
        target += (b, a)
        room += (weight, weight)
    least = 1e-9
    while True:  # flows along all shortest ways at once, then along longer ones
        sources = [k for k, x in enumerate(excess) if x > least]
        level = [-1] * len(excess)
        for k in sources:
            level[k] = 0
        queue, found = deque(sources), False
        while queue:
            k = queue.popleft()
            for e in out[k]:
                to = target[e]
                if level[to] < 0 and room[e] > least:
                    level[to] = level[k] + 1
                    found |= excess[to] < -least
                    queue.append(to)
        if not found:
            return [x >= 0 for x in level]
        tried = [0] * len(excess)
        for source in sources:
            path: list[int] = []
            k = source
            while excess[source] > least:
                if excess[k] < -least:
                    flow = min(excess[source], -excess[k], *(room[e] for e in path))
                    excess[source] -= flow
                    excess[k] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    full = next((i for i, e in enumerate(path) if room[e] <= least), len(path))
                    k = target[path[full] ^ 1] if full < len(path) else k  # back to before the first full edge
                    del path[full:]
                    continue
                edges_of = out[k]
                while tried[k] < len(edges_of):
                    e = edges_of[tried[k]]
                    if room[e] > least and level[target[e]] == level[k] + 1:
                        break
                    tried[k] += 1
                else:
                    if not path:
                        break
                    k = target[path.pop() ^ 1]
                    tried[k] += 1
                    continue
                path.append(e)
                k = target[e]


def smoothness(blocks: list[Block], w: CutWeights) -> list[tuple[int, int, float]]:
    """Edges between each block and the one before it, and the one before it under the same parent or grandparent."""
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for k, block in enumerate(blocks):
        e = block.element
        while e.parent is not None and e.name not in BLOCK:
            e = e.parent
        parent = e.parent or e
        grand = parent.parent or parent
        near: dict[int, float] = {}
        if k:
            near[k - 1] = w.next
        if id(grand) in last:
            j = last[id(grand)]
            near[j] = max(near.get(j, 0), w.near)
        if id(parent) in last:
            j = last[id(parent)]
            near[j] = max(near.get(j, 0), w.same_parent)
        edges += [(j, k, weight) for j, weight in near.items()]
        last[id(parent)] = last[id(grand)] = k
    return edges


def main_text(page: str, weights: CutWeights | None = None) -> str:
    """Content blocks in page order, white space as single spaces, joined by an empty line. Empty if there are none."""
    w = weights or CutWeights()
    blocks = page_blocks(page)
    kept = minimum_cut([block_score(b, w) for b in blocks], smoothness(blocks, w))
    return "\n\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract_pages(pages: DataFrame, weights: CutWeights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per page from its whole html, null as empty; narrow. Equal rows give equal rows."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
