"""Text expressions: cleaning, tokens, references and identifiers, as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns whose results the oracle SQL must equal.
WHITE = r"[\s\p{Z}]+"
IN_BRACKETS = r"\(\s*([^)]+?)\s*\)"
BEFORE_SIGN = r"\s+([,;:.])"
WORD_OR_SIGN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SEARCH_TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)?"
RANK_TOKEN = r"[a-z0-9.]+"
#: In this order: what is no text; a p element begins (SOH); another block begins or ends, or p ends (STX); tags left.
MARKUP_STEPS = (
    ("[\x01\x02]", " "),
    (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", ""),
    (r"(?i)<p(?:\s[^>]*|/)?>", "\x01"),
    (r"(?i)</?(?:address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hgroup|hr|html|li|main|menu|nav|ol|p|pre|search|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)(?:[\s/][^>]*)?>", "\x02"),
    (r"(?i)<br(?:[\s/][^>]*)?>", " "),
    (r"(?s)</?[a-z!?A-Z][^>]*>", ""),
)
PARAGRAPH = "\x01([^\x01\x02]*)"
#: White space at a text's ends.
OUTER_WHITE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def blank(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def clean_text(text: Column) -> Column:
    """White space collapsed, brackets and punctuation closed up."""
    out = F.trim(F.regexp_replace(blank(text), WHITE, " "))
    out = F.regexp_replace(out, IN_BRACKETS, "($1)")
    return F.trim(F.regexp_replace(out, BEFORE_SIGN, "$1"))


def normalize_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(blank(text)), WHITE, " "))


def word_tokens(text: Column) -> Column:
    """Words and single signs."""
    return F.regexp_extract_all(blank(text), F.lit(WORD_OR_SIGN), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Lower-case letters and digits; one dot inside a token is kept, so that 668.32 stays whole."""
    return F.regexp_extract_all(F.lower(blank(text)), F.lit(SEARCH_TOKEN), F.lit(0))


def rank_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(blank(text)), F.lit(RANK_TOKEN), F.lit(0)))


def paragraphs(html: Column) -> Column:
    """The whole text of each p element, '' for one without: up to the next block's tag, inner tags left out, white space collapsed; references like &amp; stay as written."""
    out = blank(html)
    for pattern, by in MARKUP_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.transform(F.regexp_extract_all(out, F.lit(PARAGRAPH), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, WHITE, " ")))


def section_ref(section: Column, path: Column) -> Column:
    """``§section(a)(1)``; parts that begin with p are left out, and an unknown section gives ''."""
    parts = F.transform(F.filter(path, lambda x: ~F.startswith(x, F.lit("p"))), lambda x: F.concat(F.lit("("), x, F.lit(")")))
    return F.when(section.isNull() | section.isin("", "unknown"), F.lit("")).otherwise(F.concat(F.lit("§"), section, F.array_join(parts, "")))


def stable_chunk_id(ref: Column, url: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", blank(ref), blank(url), blank(content)), 256), 1, 32)


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(blank(url), r"^[a-z]+://([^/?#]*)", 1), r"^www\.", "")


def source_name(url: Column) -> Column:
    """``host::last path segment``."""
    path = F.regexp_extract(blank(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.concat(url_host(url), F.lit("::"), F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1))


def url_slug(url: Column) -> Column:
    """The last segment of the path with _ for what file names shouldn't have; ``page`` without one."""
    path = F.regexp_replace(F.regexp_extract(blank(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), ";[^/]*$", "")
    tail = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(F.when(tail == "", "page").otherwise(tail), "[^a-zA-Z0-9._-]+", "_")


def snippet(text: Column, size: int = 300) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


#: Paragraph ids, where a part is read from, and the markers of pages that a bot check has blocked.
NODE_ID = r"^p-(\d+(?:\.\d+)+)((?:\([^)]+\))*)$"
PART_OF_REF, PART_OF_NODE, PART_OF_URL = r"(\d+)\.\d+", r"p-(\d+)\.\d+", r"section-(\d+)\.\d+"
BLOCK_MARKERS = ("aggressive automated scraping", "complete the captcha", "request access", "programmatic access to these sites is limited")
TOLERANT_MARKERS = ("aggressive automated scraping", "complete the captcha", "programmatic access to these sites is limited", "your request has been flagged as potentially automated")


def node_section(node: Column) -> Column:
    """The section in a paragraph's id; null where it is no such id."""
    return F.nullif(F.regexp_extract(blank(node), NODE_ID, 1), F.lit(""))


def node_path(node: Column) -> Column:
    """The labels in a paragraph's id, in order; empty where it has none."""
    return F.regexp_extract_all(F.regexp_extract(blank(node), NODE_ID, 2), F.lit(r"\(([^)]+)\)"), F.lit(1))


def infer_part(part: Column, ref: Column, node: Column, url: Column) -> Column:
    """The part, else that of the reference, of the paragraph's id or of the address; '' if none has one."""
    found = [F.trim(blank(part)), F.regexp_extract(blank(ref), PART_OF_REF, 1), F.regexp_extract(blank(node), PART_OF_NODE, 1), F.regexp_extract(blank(url), PART_OF_URL, 1)]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit(""))


def source_type(kind: Column, url: Column, regulators: tuple[str, ...] = ()) -> Column:
    """Lower-cased; a web page of one of the hosts ``regulators`` is ``cfr``; blank is ``unknown``."""
    low = F.lower(F.trim(blank(kind)))
    official = F.lit(False)
    for host in regulators:
        official = official | F.contains(F.lower(blank(url)), F.lit(host))
    return F.when(low.isin("website", "web", "html") & official, "cfr").when(low == "", "unknown").otherwise(low)


def authority_level(level: Column, kind: Column) -> Column:
    """One of statute, regulation, sub_regulatory and unknown."""
    low, of = F.lower(F.trim(blank(level))), F.lower(F.trim(blank(kind)))
    out = F.when(low == "high", F.when(of == "cfr", "regulation").otherwise("statute")).when(low == "medium", "regulation").when(low == "low", "sub_regulatory")
    return out.when(low.isin("statute", "regulation", "sub_regulatory"), low).otherwise("unknown")


def is_blocked(html: Column, markers: tuple[str, ...] = BLOCK_MARKERS, least: int = 1, expected: tuple[str, ...] = ()) -> Column:
    """Whether ``least`` of the markers stand in a page that has none of the ``expected`` texts; case doesn't count."""
    low = F.lower(blank(html))
    hits = sum((F.contains(low, F.lit(m)).cast("int") for m in markers), F.lit(0))
    fine = F.lit(False)
    for text in expected:
        fine = fine | F.contains(low, F.lit(text))
    return (hits >= least) & ~fine


def search_text(ref: Column, node: Column, title: Column, part: Column, content: Column) -> Column:
    """What keyword search reads of a record: all five, blank ones too, with spaces between."""
    return F.trim(F.concat_ws(" ", *[blank(c) for c in (ref, node, title, part, content)]))


def embedding_text(heading: Column, path: Column, text: Column) -> Column:
    """Lines of heading, path and text; blank ones are left out."""
    line = lambda name, c: F.when(F.trim(blank(c)) != "", F.concat(F.lit(f"{name}: "), F.trim(blank(c))))
    return F.concat_ws("\n", line("Heading", heading), line("Path", path), line("Text", text))
