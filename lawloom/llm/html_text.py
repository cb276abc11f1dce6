"""HTML extraction by tag-path ratios.

A page's text blocks are listed with their root-to-leaf tag paths.  For each
path, text length and punctuation per node are aggregated, smoothed along the
page, fused into one score and thresholded: blocks on the paths that pass are
content nodes.  What else lies in an article around content nodes, or beside
one, goes with them, such as titles, lists and short quotes.  Scanning and
selection take time in proportion to the page, however broken its markup is.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of HTML: elements without end tag, with raw text, that begin a block, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html head body td th tr tbody thead tfoot".split())
#: Which open elements a start tag ends, unless one of STOPS is open within.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead"), "tfoot": ("tbody", "thead"), "body": ("head",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",), "body": ()}
#: Fixed values of HTML and ARIA: elements and roles that are no part of an article's text.
NOISE_TAGS = frozenset("head script style noscript template nav header footer aside form button select option iframe svg math object canvas audio video dialog menu textarea search title".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Elements and roles that mark an article as a whole; in one, a header holds its title.
WHOLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of HTML whose content is text.
TEXT_TAGS = HEADINGS | frozenset("hgroup p blockquote pre ul ol dl table figure".split())

#: Words by which authors name what is no article, in the last or first part of a class or id; a hint that lowers a path's score.
HINTS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar comment comments cookie cookies consent notice notification alert newsletter subscribe share sharing social related recommended breadcrumb breadcrumbs pagination menu nav navbar navigation footer header toolbar popup modal widget login copyright".split())
PLAIN = frozenset("article content post entry main body story text with has no".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=]?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?)?""")
WHITE = re.compile("[ \\t\\n\\r\\f\\v\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
PUNCTUATION = re.compile(r"[.,;:!?\u2026\u00bf\u00a1\u3002\uff0c]")


@dataclass
class Block:
    text: str
    path: int
    element: int  # the innermost block element
    linked: int  # characters inside links


@dataclass
class Page:
    """Text blocks in page order, and the block elements by number; 0 is the page itself, and a parent comes before its children."""

    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    hinted: list[bool] = field(default_factory=lambda: [False])
    whole: list[bool] = field(default_factory=lambda: [False])


def attributes(page: str, at: int, ends: dict[str, int]) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on to the tag's end, and the place behind it; ``ends`` has the last place of each quote and of >."""
    found: dict[str, str] = {}
    while at < len(page) and page[at] != ">":
        m = ATTRIBUTE.match(page, at)
        if m.end() == at or (page[m.end() - 1] == "=" and m.end() < len(page) and page[m.end()] in "\"'"):
            # A quote that nothing closes: the tag goes up to the next >.
            at = page.find(">", m.end())
            if at < 0:
                break
            continue
        if m[1]:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()
        if at > ends[">"]:
            return found, len(page)
    return found, at + 1 if 0 <= at < len(page) else len(page)


def is_noise(tag: str, attrs: dict[str, str], in_whole: bool) -> bool:
    """Whether HTML itself says that an element is menu, advert, hidden or the like."""
    if tag in NOISE_TAGS:
        return not (tag == "header" and in_whole)
    if tag in ("html", "body"):
        return False
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    return hidden or any(r in NOISE_ROLES for r in attrs.get("role", "").lower().split())


def is_hinted(tag: str, attrs: dict[str, str]) -> bool:
    """Whether a class or id names what is no article."""
    if tag in ("html", "body"):
        return False
    for value in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", value) if x]
        if parts and not {"with", "has", "no"} & set(parts) and (parts[-1] in HINTS or (parts[0] in HINTS and not PLAIN & set(parts))):
            return True
    return False


def scan(markup: str) -> Page:
    """The page's text blocks outside what HTML itself marks as noise, each with its path of block elements."""
    page = Page()
    # Open elements: tag and block number (0 for inline ones); where each tag and each block stands in them.
    stack: list[tuple[str, int]] = []
    opened: dict[str, list[int]] = defaultdict(list)
    block_at: list[int] = []
    paths: dict[int, int] = {0: 0}
    numbers: dict[tuple[int, str, bool], int] = {}
    pieces: list[str] = []
    linked = 0
    noise_from = -1  # the place in the stack of the outermost noise element
    ends = {c: markup.rfind(c) for c in ">\"'"}

    def inner() -> int:
        return stack[block_at[-1]][1] if block_at else 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = WHITE.sub(" ", "".join(pieces)).strip()
            if text:
                page.blocks.append(Block(text, paths[inner()], inner(), linked))
            pieces, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and noise_from < 0:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if opened["a"]:
                linked += len(text)

    def close(to: int) -> None:
        nonlocal noise_from
        if block_at and block_at[-1] >= to:
            flush()
        while len(stack) > to:
            tag, number = stack.pop()
            opened[tag].pop()
            if number:
                block_at.pop()
        if noise_from >= to:
            noise_from = -1

    def last(tags: tuple[str, ...]) -> int:
        return max((opened[t][-1] for t in tags if opened[t]), default=-1)

    at = 0
    while True:
        start = markup.find("<", at)
        if start < 0:
            break
        begin = markup[start + 1 : start + 2]
        if begin in ("!", "?"):
            add(markup[at:start])
            end = markup.find("-->", start + 4) + 3 if markup.startswith("<!--", start) else markup.find(">", start) + 1
            at = end if end > 2 or (end > 0 and markup[start : start + 4] != "<!--") else len(markup)
            continue
        shut = begin == "/"
        name = NAME.match(markup, start + 1 + shut)
        if not name:
            # No tag, but text.
            add(markup[at : start + 1])
            at = start + 1
            continue
        add(markup[at:start])
        if start > ends[">"]:
            at = len(markup)  # the tag never ends
            break
        attrs, at = attributes(markup, name.end(), ends)
        tag = name[0].lower()
        if shut:
            place = last((tag,))
            if place >= 0 and (tag in BLOCK or stack[place][1] or not block_at or block_at[-1] < place):
                close(place)
            elif tag == "p" or tag in BLOCK:
                flush()
            continue
        if tag in CLOSES_P and block_at and stack[block_at[-1]][0] == "p":
            close(block_at[-1])
        if tag in CLOSED_BY:
            place = last(CLOSED_BY[tag])
            if place > last(STOPS[tag]):
                close(place)
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag == "br":
                add(" ")
            continue
        in_whole = page.whole[inner()]
        noise, hinted = is_noise(tag, attrs, in_whole), is_hinted(tag, attrs)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(markup, at)
            if not end:
                at = len(markup)
                break
            at = markup.find(">", end.start()) + 1 or len(markup)
            continue
        number = 0
        if noise_from < 0 and (tag in BLOCK or hinted):
            flush()
            outer, number = inner(), len(page.parent)
            page.parent.append(outer)
            page.tag.append(tag)
            page.hinted.append(hinted)
            page.whole.append(in_whole or tag in WHOLE or attrs.get("role", "").lower() in WHOLE)
            # Paths are numbered by their parent's and the tag, whatever their depth; those with a hint are negative.
            step = numbers.setdefault((paths[outer], tag, hinted), len(numbers) + 1)
            paths[number] = -step if hinted or paths[outer] < 0 else step
        opened[tag].append(len(stack))
        if number:
            block_at.append(len(stack))
        if noise and noise_from < 0:
            flush()
            noise_from = len(stack)
        stack.append((tag, number))
    add(markup[at:])
    flush()
    return page


#: Weights of the smoothing over neighbouring blocks.
SMOOTHING = (0.1, 0.8, 0.1)
#: A path is content if its fused score reaches this part of the highest one.
THRESHOLD = 0.35
#: What a hint leaves of a path's score.
HINTED = 0.05
#: What is beside content nodes goes with them if less than this part of it is links.
LINKED = 0.5


def path_scores(found: list[Block]) -> dict[int, float]:
    """For each tag path: smoothed text-to-path ratio fused with its punctuation-to-path ratio, lowered by links and hints."""
    size: dict[int, float] = defaultdict(float)
    marks: dict[int, float] = defaultdict(float)
    links: dict[int, float] = defaultdict(float)
    nodes: dict[int, int] = defaultdict(int)
    for b in found:
        size[b.path] += max(0, len(b.text) - b.linked)
        links[b.path] += b.linked
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        nodes[b.path] += 1
    ratio = [math.log1p(size[b.path] / nodes[b.path]) * math.log1p(1 + marks[b.path] / nodes[b.path]) for b in found]
    sums: dict[int, float] = defaultdict(float)
    for i, b in enumerate(found):
        near = [(w, ratio[i + k]) for k, w in zip((-1, 0, 1), SMOOTHING, strict=True) if 0 <= i + k < len(found)]
        sums[b.path] += sum(w * r for w, r in near) / sum(w for w, _ in near)
    # Paths with more text in all count for more than a single long advert.
    fused = {p: sums[p] / nodes[p] * math.sqrt(math.log1p(nodes[p] + size[p] / 200)) for p in sums}
    return {p: x * (size[p] + 1) / (size[p] + links[p] + 1) * (HINTED if p < 0 else 1) for p, x in fused.items()}


def chosen_paths(found: list[Block]) -> set[int]:
    """The paths whose score passes."""
    scores = path_scores(found)
    limit = THRESHOLD * max(scores.values())
    return {p for p, x in scores.items() if x >= limit}


def select(page: Page) -> list[Block]:
    """The content nodes, and what goes with them.

    Of a block on another path, the nearest element around it that holds
    content nodes decides: it is taken if that lies in an article or main
    element, if a content node stands beside it there, or if it lies in a text
    element there, such as a heading, paragraph or list (in the body, a heading
    of the first level only); never if it is mostly links, or if a hint names it.
    """
    found = page.blocks
    if not found:
        return []
    paths = chosen_paths(found)
    n = len(page.parent)
    held, beside, chars, linked, hints = [0] * n, [False] * n, [0] * n, [0] * n, [0] * n
    for b in found:
        chars[b.element] += len(b.text)
        linked[b.element] += b.linked
        if b.path in paths:
            held[b.element] += 1
            beside[b.element] = beside[page.parent[b.element]] = True
    for e in range(n - 1, 0, -1):
        for sums in (held, chars, linked):
            sums[page.parent[e]] += sums[e]
    # The nearest element with content nodes, and the part of it that a block without any lies in.
    meeting = [(0, 0)] * n
    for e in range(1, n):
        hints[e] = hints[page.parent[e]] + page.hinted[e]
        meeting[e] = (e, e) if held[e] else (page.parent[e], e) if held[page.parent[e]] else meeting[page.parent[e]]

    def taken(b: Block) -> bool:
        if b.path in paths:
            return True
        at, part = meeting[b.element]
        alone = at == part
        if hints[b.element] > hints[at] or (b.linked if alone else linked[part]) >= LINKED * (len(b.text) if alone else chars[part]):
            return False
        in_body = page.tag[at] in ("", "html", "body")
        text = page.tag[part] == "h1" if in_body else page.tag[part] in TEXT_TAGS
        return page.whole[at] or beside[at] or text

    return [b for b in found if taken(b)]


def main_text(markup: str | None) -> str:
    """The article's blocks, joined by line ends; '' for a null, empty or textless page."""
    return "\n".join(b.text for b in select(scan(markup))) if markup else ""


def extract(pages: DataFrame, markup: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``markup`` added or replaced.

    Null, empty and textless pages give ''.  Whole pages are read, of any
    length; each row, repeated ones too, is handled alone and keeps its other
    columns.  White space inside a block, no-break spaces included, becomes one
    space; a line break element counts as white space.
    """
    pages = pages.drop(text)
    schema = pages.select("*", F.lit("").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, markup):
            texts = [main_text(x.as_py()) for x in batch.column(markup)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return pages.mapInArrow(run, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
