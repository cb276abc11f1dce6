"""Sections as published: their paragraphs, from pages with paragraph ids and from XML, and the issue date of a title."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BEFORE_SIGN, IN_BRACKETS, NODE_ID, blank
from ..functions.text import source_name as named_source
from . import chunks

#: The number of a section in a heading and in an address, the part in an address, what a page without paragraph ids says where it has no text, and what stands for headers.
HEADING = r"§\s*(\d+(?:\.\d+)+)"
URL_SECTION, URL_PART = r"/section-(\d+(?:\.\d+)+)", r"/part-(\d+)"
NO_CONTENT = "ECFR CONTENT"
TITLE = "34 CFR"
#: HTML's own names: elements without text, without an end, those at whose start an open p ends, and those that end others up to a border.
SILENT = frozenset(("script", "style", "nav"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ENDS_P = frozenset(("address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", *HEADINGS, "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",)), **{h: (HEADINGS, ()) for h in HEADINGS},
}

#: Sources of which the results are in memory together.
ROWS_AT_ONCE = 64
#: The same white space as ``functions.text.WHITE``: that of ASCII and Unicode's separators.
_WHITE = re.compile("[ \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_BRACKETS, _SIGN = re.compile(IN_BRACKETS, re.ASCII), re.compile(BEFORE_SIGN, re.ASCII)
_NODE, _NUMBER = re.compile(NODE_ID, re.ASCII), re.compile(HEADING, re.ASCII)


def _clean(text: str) -> str:
    """``functions.text.clean_text`` of a string."""
    return _SIGN.sub(r"\1", _BRACKETS.sub(r"(\1)", _WHITE.sub(" ", text).strip(" "))).strip(" ")


class _Texts:
    """Text nodes in order, and items that span some of them: an item is the places at which it begins and ends, however many are open."""

    def __init__(self) -> None:
        self.nodes: list[str] = []
        self.pending: list[str] = []
        #: Kind, name, first node and last + 1 (None while open).
        self.items: list[list] = []

    def flush(self) -> None:
        text = "".join(self.pending).strip()
        self.pending.clear()
        if text:
            self.nodes.append(text)

    def begin(self, kind: str, name: str = "") -> list:
        self.items.append([kind, name, len(self.nodes), None])
        return self.items[-1]

    def text(self, item: list) -> str:
        return _clean(" ".join(self.nodes[item[2] : item[3]]))


#: Where markup begins, and the whole of a tag: quoted values may hold its end; the second form is for sources of which a quote stays open.
_BEGIN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[A-Za-z_:])")
_TAG = re.compile(r"""</?([^\s/>]++)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_BARE_TAG = re.compile(r"</?([^\s/>]++)([^>]*+)>")
_ID = re.compile(r"""(?:^|[\s"'/])id\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: HTML's elements whose text has no markup.
RAW = ("script", "style", "textarea", "title")


def _read(source: str, into: _Page | _Xml, raw: tuple[str, ...] = ()) -> None:
    """Calls ``into`` for each start, end and text of markup of any kind, in one pass: no place is read again from another one.

    A sign that begins no markup is text, and what is begun and never ended ends
    with the source.
    """
    at, tag = 0, _TAG
    while m := _BEGIN.search(source, at):
        into.texts.pending.append(unescape(source[at : m.start()]))
        here = m.start()
        kind = m.group()
        if kind in ("<!--", "<![CDATA["):
            end = source.find("-->" if kind == "<!--" else "]]>", m.end())
            if kind != "<!--":
                into.texts.pending.append(source[m.end() : end if end >= 0 else None])
            else:
                into.texts.flush()
            at = end + 3 if end >= 0 else len(source)
        elif kind in ("<!", "<?"):
            into.texts.flush()
            end = source.find(">", here)
            at = end + 1 if end >= 0 else len(source)
        else:
            found = tag.match(source, here)
            if not found and tag is _TAG:
                tag = _BARE_TAG
                found = tag.match(source, here)
            if not found:
                at = len(source)
                break
            at = found.end()
            name = found[1].lower() if raw else found[1]
            if kind[1] == "/":
                into.end(name)
                continue
            into.start(name, found[2])
            if not raw and found[2].endswith("/"):
                into.end(name)
            elif name in raw:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                into.texts.pending.append(source[at : end.start() if end else None])
                at = end.start() if end else len(source)
    into.texts.pending.append(unescape(source[at:]))


class _Page:
    """The items of a page: headings (h), elements whose id begins with p- (id), and p elements (p, or article in the first article)."""

    def __init__(self) -> None:
        self.texts = _Texts()
        self.open: list[tuple[str, list[list]]] = []
        #: Where in ``open`` the elements of each name are.
        self.at: dict[str, list[int]] = {}
        self.silent = 0
        self.article: int | None = None
        self.any_article = False

    def _last(self, names: tuple[str, ...]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def _flush(self) -> None:
        if self.silent:
            self.texts.pending.clear()
        self.texts.flush()

    def _close(self, at: int) -> None:
        self._flush()
        while len(self.open) > at:
            tag, found = self.open.pop()
            self.at[tag].pop()
            self.silent -= tag in SILENT
            for item in found:
                item[3] = len(self.texts.nodes)
        if self.article is not None and self.article >= at:
            self.article = None

    def start(self, tag: str, attributes: str) -> None:
        self._flush()
        if tag in ENDS_P and (at := self._last(("p",))) >= 0:
            self._close(at)
        if tag in ENDS:
            names, borders = ENDS[tag]
            if (at := self._last(names)) > self._last(borders):
                self._close(at)
        if tag in VOID:
            return
        self.silent += tag in SILENT
        if tag == "article" and not self.any_article:
            self.any_article, self.article = True, len(self.open)
        found = []
        if not self.silent:
            named = _ID.search(attributes)
            node = unescape(next(x for x in named.groups() if x is not None)) if named else ""
            if tag in HEADINGS[:5]:
                found.append(self.texts.begin("h"))
            if node.startswith("p-"):
                found.append(self.texts.begin("id", node))
            if tag == "p":
                found.append(self.texts.begin("p" if self.article is None else "article"))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, found))

    def end(self, tag: str) -> None:
        self._flush()
        if self.at.get(tag):
            self._close(self.at[tag][-1])


def _page(html: str) -> _Page:
    page = _Page()
    _read(html, page, RAW)
    page._close(0)
    page._flush()
    return page


def _section_of(node: str) -> str | None:
    found = _NODE.match(node)
    return found[1] if found else None


def _content(html: str, url: str | None) -> tuple[str, str, list[tuple[str | None, str]]]:
    """(section, heading, (id, text) of each paragraph) of a page; by its address, if there is one, else by what it says."""
    page = _page(html)
    texts = page.texts
    heads = (texts.text(i) for i in texts.items if i[0] == "h")
    named = [(i, _section_of(i[1])) for i in texts.items if i[0] == "id"]
    if url is not None:
        heading = next((h for h in heads if "§" in h), "")
        found = re.search(URL_SECTION, url)
        section = found[1] if found else ""
    else:
        heading = next((h for h in heads if _NUMBER.search(h)), "")
        found = _NUMBER.search(heading)
        # Of sections named equally often the first; a Counter keeps the order in which it met them.
        common = Counter(s for _, s in named if s)
        section = found[1] if found else max(common, key=common.get, default="")
    fits = lambda s: s == section if section else url is not None or s is not None
    rows = [(i[1], t) for i, s in named if fits(s) and (t := texts.text(i))]
    if not rows:
        kind = "article" if page.any_article else "p"
        rows = [(None, t) for i in texts.items if i[0] == kind and (t := texts.text(i)) and NO_CONTENT not in t]
    return section, heading, rows


def _rows(source: DataFrame, key: str, columns: list[str], read: Callable[..., tuple[str, list[tuple]]], fields: str) -> DataFrame:
    """One Arrow pass over ``source``: for each row what ``read`` makes of ``columns``, under its key."""
    schema = f"page_key {dict(source.dtypes)[key]}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            out: list[tuple] = []
            for at, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(at, *row) for row in read(*values)]
            cells = list(zip(*out, strict=True)) or [()] * len(names)
            types = (batch.column(0).type, *(pa.int32() if f.endswith(" int") else pa.string() for f in fields.split(", ")))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names)

    names = ["page_key", *(f.split()[0] for f in fields.split(", "))]
    return source.select(key, *columns).mapInArrow(run, schema).withColumnRenamed("page_key", key)


def section_content(pages: DataFrame, key: str, html: str, url: str | None = None) -> DataFrame:
    """(key, section, heading, n, node_id, text): the paragraphs of each page's section, in the order of the page.

    Without ``url``, the section is that of the first heading that names one,
    else the one that most paragraph ids name.  With it (a column; null: ''), the
    section is the address', the heading is the first with a paragraph sign, and
    an address without a section keeps all paragraphs with ids.  Where none is
    left that has text, the p elements of the first article stand in, without
    ids, or those of the page if it has no article.  A page without any text, or
    null, has no rows; repeated pages have theirs each time.  Pages are read in one
    pass that takes time in proportion to their length and what they hold.
    """

    def read(html: str | None, *url: str | None) -> list[tuple]:
        section, heading, rows = _content(html or "", (url[0] or "") if url else None)
        return [(section, heading, n, node, text) for n, (node, text) in enumerate(rows, 1)]

    return _rows(pages, key, [html, *([url] if url else [])], read, "section string, heading string, n int, node_id string, text string")


def section_header(section: Column, heading: Column, url: Column) -> dict[str, Column]:
    """What a section's record has beside its paragraphs, from its number, its heading and its address; blank where neither says it."""
    number, at = blank(section), blank(url)
    title = F.coalesce(F.nullif(blank(heading), F.lit("")), F.when(number != "", F.concat(F.lit(f"{TITLE} §"), number)), F.lit(TITLE))
    return {
        "source_name": named_source(at), "source_url": at, "source_type": F.lit("cfr"), "authority_level": F.lit("regulation"), "document_title": title,
        "section_ref": F.when(number != "", F.concat(F.lit("§"), number)).otherwise(""), "part": F.regexp_extract(at, URL_PART, 1), "title": F.lit("34"), "chapter": F.lit("VI"), "volume": F.lit(""),
    }


def with_defaults(rows: DataFrame, defaults: dict[str, str], sidecar: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """``rows`` with what ``sidecar`` (one row for each ``key``) says, else their own values, else ``defaults``; blank values say nothing."""
    said = lambda c: F.nullif(F.trim(blank(c)), F.lit(""))
    names = list(defaults)
    if sidecar is not None:
        more = [c for c in names if c in sidecar.columns]
        rows = rows.join(sidecar.select(key, *[F.col(c).alias(f"_{c}") for c in more]), key, "left")
        given = {c: [said(F.col(f"_{c}"))] for c in more}
    else:
        given = {}
    value = {c: F.coalesce(*given.get(c, []), *([said(F.col(c))] if c in rows.columns else []), F.lit(defaults[c])) for c in names}
    return rows.withColumns(value).drop(*[f"_{c}" for c in given])


class _Xml:
    """HEAD and P elements of an XML section, with the whole text of each."""

    def __init__(self) -> None:
        self.texts = _Texts()
        self.open: list[tuple[str, list | None]] = []
        self.names: Counter[str] = Counter()

    def start(self, name: str, attributes: object = None) -> None:
        self.texts.flush()
        self.open.append((name, self.texts.begin(name) if name in ("HEAD", "P") else None))
        self.names[name] += 1

    def end(self, name: str) -> None:
        """Ends without a start say nothing; a start without an end ends with what holds it."""
        self.texts.flush()
        while self.names[name]:
            tag, item = self.open.pop()
            self.names[tag] -= 1
            if item:
                item[3] = len(self.texts.nodes)
            if tag == name:
                return

    def close(self) -> None:
        self.texts.flush()
        for _, item in self.open:
            if item:
                item[3] = len(self.texts.nodes)


def _parsed(xml: str) -> _Xml:
    out = _Xml()
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = out.start, out.end, out.texts.pending.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: out.texts.flush()
    try:
        parser.Parse(xml.encode(), True)
    except expat.ExpatError:
        out = _Xml()
        _read(xml, out)
    out.close()
    return out


def section_xml(sections: DataFrame, key: str, section: str, xml: str) -> DataFrame:
    """(key, section, heading, n, node_id, text): every P of each section that has text, with an id from the labels before it.

    The heading is the first HEAD, or the section's number without one; ``n``
    counts all P elements from 1.  An element's text is that of all elements in
    it, CDATA and character references included, with a space where markup
    stands between.  XML that isn't well-formed is read as far as it goes, with
    HTML's names of characters.  Null sources have no rows.
    """

    def read(number: str | None, xml: str | None) -> list[tuple]:
        found = _parsed(xml or "")
        heads = [i for i in found.texts.items if i[0] == "HEAD"]
        heading = found.texts.text(heads[0]) if heads else f"§ {number}"
        return [(number, heading, n, found.texts.text(i)) for n, i in enumerate((i for i in found.texts.items if i[0] == "P"), 1)]

    rows = _rows(sections.withColumn(section, F.col(section).cast("string")), key, [section, xml], read, "section string, heading string, n int, text string")
    return chunks.paragraph_ids(rows, key, "section", "n", "text").select(key, "section", "heading", "n", "node_id", "text")


def issue_dates(titles: DataFrame, title: str) -> DataFrame:
    """(number, issue_date): the first row of ``titles`` (number, latest_issue_date, pos) of a ``title`` with a date; an error if there is none."""
    fits = titles.where((F.col("number").cast("string") == title) & (F.trim(blank(F.col("latest_issue_date"))) != ""))
    found = fits.agg(F.min_by(F.trim("latest_issue_date"), "pos").alias("issue_date"))
    missing = F.raise_error(F.lit(f"no issue date for title {title}"))
    return found.select(F.lit(title).alias("number"), F.coalesce("issue_date", missing.cast("string")).alias("issue_date"))
