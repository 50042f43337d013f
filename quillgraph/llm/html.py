"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its root-to-leaf tag path. Per path the text length and the punctuation
are added up over all of its nodes; a path's text ratio is characters a node, its punctuation ratio marks a node.
Both are smoothed over the page order of the nodes (a Gaussian window), scaled to their means and fused by their
product; paths whose fused ratio reaches a share of the page's mean (by characters) hold content. Nodes of content
paths are selected, with what else stands in the element that holds them (an article's headings and lists); what lies in parts that are never content (navigation, forms, scripts, comments of readers and the
like, by tag name or by class and id words) is left out beforehand, so it can't lift a path.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the smoothing window in nodes, and the share of the mean fused ratio that content reaches.
SPREAD, SHARE = 1.0, 0.15

# Fixed values of HTML: elements without an end, elements whose content is not text, blocks, and closing rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Never content, whatever its ratio.
OUTSIDE = frozenset("head script style noscript template iframe object embed svg math canvas nav footer aside form button input select textarea option dialog menu title".split())
# Words that mark such parts, as a class, id or role, or as its first or last part; and those of readers' comments.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent footer header masthead menu modal nav navbar "
    "navigation newsletter notice popup promo promoted related share sharing sidebar skip social sponsor sponsored sponsors subscribe toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: Before such a word these say something about the element around (has-sidebar) or about the article (entry-header).
ABOUT = frozenset("has is no not show hide with without".split())
OF_CONTENT = frozenset("article blog content entry main post story".split())
#: An element so marked is looked at again if the rest of the page has less than this share of the text inside of it.
LITTLE = 0.25
#: A start tag of the first kind ends an open element of the second (and what is open inside of it).
P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div body main aside nav footer header form td th li select".split())

# Quotes delimit an attribute's value right after "=" only; elsewhere they are characters like any other.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACES = re.compile(r"\s+")
MARKS = re.compile(r"[.,;:!?…。、，！？؛،]")


def marked_as(attributes: str) -> str:
    """What an element's class, id and role say it is: ``comments``, ``outside`` or nothing."""
    found = ""
    for _, *values in ATTRIBUTE.findall(attributes):
        for token in "".join(values).lower().split():
            parts = [x for x in re.split(r"[-_:]+", token) if x]
            if not parts or (len(parts) > 1 and parts[0] in ABOUT):
                continue
            ends = {parts[0], parts[-1]}
            if ends & COMMENT_WORDS:
                return "comments"
            if parts[0] in OUTSIDE_WORDS or (parts[-1] in OUTSIDE_WORDS and not ("header" == parts[-1] and parts[0] in OF_CONTENT)):
                found = "outside"
    return found


class Node(NamedTuple):
    """A text node: tag names and numbers of its open elements, its block (numbers change where one begins or ends), its
    text, whether it is never content, and the marked elements that it lies in."""

    path: tuple[str, ...]
    elements: tuple[int, ...]
    block: int
    text: str
    outside: bool
    marked: tuple[int, ...]


class Open(NamedTuple):
    tag: str
    hidden: bool
    number: int
    marked: bool


def text_nodes(page: str, marks: dict[int, str], holds: set[int]) -> Iterator[Node]:
    """The text nodes of a page in order. ``marks`` gets what elements are marked as, ``holds`` those that are marked and
    have an article, the main part or a first heading in them."""
    stack: list[Open] = []
    block = at = out = number = 0
    last = page.rfind(">") + 1  # no tag ends behind it
    while True:
        m = TOKEN.search(page, at, last)
        piece = page[at : m.start()] if m else page[at:].partition("<!--")[0]  # an open comment goes on to the end
        if piece:
            yield Node(tuple(o.tag for o in stack), tuple(o.number for o in stack), block, entities.unescape(piece), out > 0, tuple(o.number for o in stack if o.marked))
        if not m or (m.end() == last and m.group().startswith("<!--") and not m.group().endswith("-->")):
            return
        at = m.end()
        close, open_, attributes = m.group(1), m.group(2), m.group(3)
        if close:
            tag = close.lower()
            if any(o.tag == tag for o in stack):
                while stack:
                    ended = stack.pop()
                    out -= ended.hidden
                    if ended.tag == tag:
                        break
            if tag in BLOCKS:
                block += 1
        elif open_:
            tag = open_.lower()
            if tag in BLOCKS:
                block += 1
            if tag in P_ENDERS and any(o.tag == "p" for o in stack):
                out -= _close(stack, ("p",))
            elif tag in SIBLINGS:
                out -= _close(stack, SIBLINGS[tag])
            if tag in VOID or attributes.endswith("/"):
                continue
            hidden = tag in OUTSIDE or tag == "header" and not any(o.tag in ("article", "main") for o in stack)
            mark = marked_as(attributes) if attributes and not hidden and tag not in ("html", "body", "main") else ""
            if tag in RAW:  # its content is not markup: go on at its end tag
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = end.start() if end else len(page)
            number += 1
            if mark and tag == "article" and mark != "comments":
                mark = ""
            if mark:
                marks[number] = mark
            elif tag in ("article", "main", "h1") and not out:
                holds.update(o.number for o in stack if o.marked)
            stack.append(Open(tag, hidden, number, bool(mark)))
            out += hidden


def inside_of(nodes: list[Node], marks: dict[int, str], holds: set[int]) -> list[Node]:
    """The nodes that may be content: not in what is never content, nor in a marked element, unless it is one around the
    page's text. Comments are shown only where there is nothing else; another marked element that holds the article, or
    next to which there is little text, is not taken at its word."""
    nodes = [n for n in nodes if not n.outside]
    weight = [len(n.text.strip()) for n in nodes]
    within: dict[int, int] = defaultdict(int)
    for n, w in zip(nodes, weight):
        for k in n.marked:
            within[k] += w
    shown: set[int] = set()
    clear = sum(w for n, w in zip(nodes, weight) if not n.marked)
    for k in sorted(within):  # outer elements come first
        if marks[k] == "comments":
            shows = not clear and len(within) == 1
        else:
            shows = k in holds or clear < LITTLE * within[k]
        if shows:
            shown.add(k)
            clear = sum(w for n, w in zip(nodes, weight) if shown.issuperset(n.marked))
    return [n for n in nodes if shown.issuperset(n.marked)]


def _close(stack: list[Open], tags: tuple[str, ...]) -> int:
    """Ends the innermost open element of ``tags`` in this scope; returns how many outside parts that ends."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].tag in tags:
            ended = sum(o.hidden for o in stack[k:])
            del stack[k:]
            return ended
        if stack[k].tag in SCOPES:
            return 0
    return 0


def content_paths(order: list[tuple], texts: list[str], spread: float = SPREAD, share: float = SHARE) -> set[tuple]:
    """The paths that hold content, of text nodes in page order (their paths and texts)."""
    size, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text in zip(order, texts):
        size[path] += len(SPACES.sub(" ", text.strip()))
        marks[path] += len(MARKS.findall(text))
        count[path] += 1
    long = smooth(np.array([size[p] / count[p] for p in order]), spread)
    points = smooth(np.array([(marks[p] + 1) / count[p] for p in order]), spread)
    fused = (long / long.mean()) * (points / points.mean())
    best: dict[tuple, float] = defaultdict(float)
    for p, x in zip(order, fused):
        best[p] = max(best[p], x)
    weight = np.array([size[p] / count[p] for p in order])
    bar = share * float((fused * weight).sum() / weight.sum())
    return {p for p, x in best.items() if x >= bar}


def main_text(page: str | None, spread: float = SPREAD, share: float = SHARE) -> str:
    marked: dict[int, str] = {}
    holds: set[int] = set()
    nodes = [n[:4] for n in inside_of(list(text_nodes(page or "", marked, holds)), marked, holds)]
    # White space between blocks is no node of its own, but separates words within a block.
    real = [(content_path(path), text) for path, _, _, text in nodes if text.strip()]
    if not real:
        return ""
    kept = content_paths([p for p, _ in real], [t for _, t in real], spread, share)
    holders = {h for path, elements, _, text in nodes if text.strip() and content_path(path) in kept and (h := holder(path, elements))}
    chosen, last = [], None
    for path, elements, block, text in nodes:
        if content_path(path) not in kept and holders.isdisjoint(elements):
            continue
        if block != last:
            chosen.append([])
            last = block
        chosen[-1].append(text)
    blocks = (SPACES.sub(" ", "".join(parts)).strip() for parts in chosen)
    return " ".join(b for b in blocks if b)


#: Tags that dress words inside a block; a path leaves them out, so that emphasis doesn't split a paragraph's path.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())


def holder(path: tuple[str, ...], elements: tuple[int, ...]) -> int | None:
    """The number of the element around a text node's block, if it is a part of the page and not all of it."""
    k = len(path) - 1
    while k >= 0 and path[k] in INLINE:
        k -= 1
    while k > 0 and path[k] == "p" and path[k - 1] == "p":  # paragraphs left open
        k -= 1
    return elements[k - 1] if k > 0 and path[k - 1] not in ("html", "body") else None


def content_path(path: tuple[str, ...]) -> tuple[str, ...]:
    found = [t for t in path if t not in INLINE]
    # A paragraph left open holds the next one in broken pages; repeats of a tag add nothing to a path.
    return tuple(t for k, t in enumerate(found) if not k or found[k - 1] != t)


def smooth(values: np.ndarray, spread: float) -> np.ndarray:
    """A Gaussian window over the nodes' order; at the ends only what is there counts."""
    reach = max(1, int(3 * spread))
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    part = slice(reach, reach + len(values))
    return np.convolve(values, window)[part] / np.convolve(np.ones(len(values)), window)[part]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row; text is empty for a null or empty page and one without content.

    Pages are read whole, whatever their length or how broken their markup. Rows with null or repeated ids are
    extracted like any other; other columns are ignored. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
