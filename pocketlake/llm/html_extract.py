"""Main text of web pages by tag-path ratios.

A page is read into blocks, each with the path of its block elements from the root. Blocks in regions that say what they
are (menus, footers, forms, adverts, comments, scripts ...) are out. For every path of the others, text length and
punctuation are added up and divided by the number of blocks on the path. The two ratios are smoothed over the page, fused,
and paths below a share of the page's best are not content by themselves. The content nodes are the article or main
elements if they hold enough of the fused weight, else the deepest element that holds most of it; blocks within them
are kept whatever their length, so short paragraphs and headings stay.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import map_rows

#: Elements of the HTML standard by the part they play here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
NEVER_CONTENT = frozenset("nav footer aside form button select datalist dialog menu svg canvas object audio video map head".split())
CONTENT = frozenset("article main".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An element that starts closes an open one of the named kinds, unless one of the last kinds stands between.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words in a class, id or role that name a region beside the content.
REGION_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar rail "
    "nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup social share sharing related "
    "recommended recommendations comment comments commentlist reply replies respond disqus discussion widget toolbar "
    "pagination pager login search form complementary contentinfo dialog disclaimer legal".split()
)
#: Regions that may stand inside an article without being beside it.
FINE_IN_CONTENT = frozenset("header banner".split())

#: Share of the best path's fused ratio that makes a path content by itself, and how far ratios are smoothed, in blocks.
THRESHOLD = 0.2
SMOOTHING = 2
#: Share of the fused weight that article elements must hold to be the content nodes, and that any other element must.
ARTICLE_SHARE, ELEMENT_SHARE = 0.3, 0.6
#: Share of a block's text in links above which it is a list of links.
LINKED = 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…。、，！？；：]")


class Element:
    __slots__ = ("tag", "step", "parent", "region", "excluded", "holds_content", "in_content")

    def __init__(self, tag: str, step: str, parent: Element | None, region: bool, excluded: bool):
        self.tag, self.step, self.parent = tag, step, parent
        #: Named as a region by its attributes, which counts only if no article stands inside.
        self.region = region
        self.excluded = excluded or (parent is not None and parent.excluded)
        self.holds_content = False
        self.in_content = tag in CONTENT or (parent is not None and parent.in_content)

    def chain(self) -> list[Element]:
        out, at = [], self
        while at is not None:
            out.append(at)
            at = at.parent
        return out[::-1]


class Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)} if source else {}


def names_region(given: dict[str, str], in_content: bool) -> bool:
    words: set[str] = set()
    for name in ("class", "id", "role"):
        if value := given.get(name):
            words.update(x.lower() for x in _NAME_PARTS.findall(value))
            words.update(re.split(r"[^a-z0-9]+", value.lower()))
    named = words & REGION_WORDS
    return bool(named - FINE_IN_CONTENT if in_content else named)


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, those of excluded elements left out."""
    root = Element("", "", None, False, False)
    stack = [root]
    blocks: list[Block] = []
    buffer: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text and not stack[-1].excluded:
                blocks.append(Block(text, linked, stack[-1]))
        buffer, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if links:
            linked += len(text.strip())

    def close(tags: set[str], within: set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                del stack[depth:]
                return
            if stack[depth].tag in within:
                return

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing = (found[1] if found[2] else found[4]) == "/"
        source = found[3] if found[2] else found[6]
        if tag in RAW:
            if not closing and not source.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
                close({"p"}, set(CLOSES_PARAGRAPH) - {"p"})
            continue
        if tag in INLINE:
            if closing or not source:
                if closing and stack[-1].tag == tag:
                    flush()
                    stack.pop()
                continue
            given = attributes(source)
            if not (names_region(given, stack[-1].in_content) or "hidden" in given):
                continue
        else:
            given = attributes(source) if source else {}
        flush()
        if closing:
            if any(e.tag == tag for e in stack[1:]):
                close({tag}, set())
            links = 0
            continue
        if tag in CLOSES_PARAGRAPH:
            close({"p"}, set(CLOSES_PARAGRAPH) - {"p"})
        if tag in IMPLIED_ENDS:
            close(*IMPLIED_ENDS[tag])
        top = stack[-1]
        region = tag not in ("html", "body", *CONTENT) and names_region(given, top.in_content)
        gone = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        gone |= tag in NEVER_CONTENT or (tag == "header" and not top.in_content)
        first = given.get("class", "").split()
        element = Element(tag, f"{tag}.{first[0]}" if first else tag, top, region, gone)
        if tag in CONTENT:
            for e in stack:
                e.holds_content = True
        if tag not in ("html", "body") or not any(e.tag == tag for e in stack):
            stack.append(element)
    flush()
    return [b for b in blocks if not any(e.region and not e.holds_content for e in b.element.chain())]


def smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbouring blocks."""
    if len(values) < 2:
        return values
    reach = min(2 * SMOOTHING, len(values) - 1)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SMOOTHING**2))
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def path_ratios(blocks: list[Block]) -> tuple[list[str], np.ndarray]:
    """(path of every block, fused ratio of its path): smoothed text and punctuation per block of the path."""
    paths = ["/".join(e.step for e in b.element.chain()) for b in blocks]
    sums: dict[str, np.ndarray] = {}
    for path, block in zip(paths, blocks, strict=True):
        own = np.array([max(0, len(block.text) - block.linked), len(_MARKS.findall(block.text)), 1.0])
        sums[path] = sums.get(path, 0) + own
    text = smooth(np.array([sums[p][0] / sums[p][2] for p in paths]))
    marks = smooth(np.array([sums[p][1] / sums[p][2] for p in paths]))
    fused = np.sqrt(text * (1 + marks))
    mean: dict[str, list[float]] = {}
    for path, value in zip(paths, fused, strict=True):
        mean.setdefault(path, []).append(float(value))
    return paths, np.array([sum(mean[p]) / len(mean[p]) for p in paths])


def main_text(page: str) -> str:
    """The kept blocks, one line each; empty if there are none."""
    blocks = read_blocks(page)
    if not blocks:
        return ""
    paths, ratio = path_ratios(blocks)
    weight = ratio * np.array([max(1, len(b.text) - b.linked) for b in blocks])
    whole = weight.sum() or 1.0
    inside = np.array([b.element.in_content for b in blocks])
    if weight[inside].sum() < ARTICLE_SHARE * whole:
        held: dict[Element, float] = {}
        depth: dict[Element, int] = {}
        for block, w in zip(blocks, weight, strict=True):
            for d, element in enumerate(block.element.chain()):
                held[element] = held.get(element, 0.0) + float(w)
                depth[element] = d
        content = max((e for e in held if held[e] >= ELEMENT_SHARE * whole and e.tag not in ("p", "li", "td")), key=lambda e: depth[e])
        strong = ratio >= THRESHOLD * ratio.max()
        linked = np.array([b.linked > LINKED * len(b.text) for b in blocks])
        inside = np.array([content in b.element.chain() for b in blocks]) & (strong | ~linked)
    return "\n".join(b.text for b, keep in zip(blocks, inside, strict=True) if keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars): the main text of every page, from the whole source.

    Null and empty pages, and pages without content, have an empty text. ``n_chars`` counts code points. Null keys and repeated rows
    stay; other columns are left out.
    """
    extra = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def make():
        def of(body: bytes | None) -> tuple[str, int]:
            text = main_text((body or b"").decode("utf-8", errors="replace"))
            return text, len(text)

        return of

    return map_rows(pages, [key, url], source, extra, make)
