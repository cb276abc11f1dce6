"""What a question asks for: a paragraph, a part, a citation, or nothing in the corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank

#: Small talk, programme names that stand for a part, and reference patterns.
SMALL_TALK = r"(?i)\b(what\s+is\s+your\s+name|who\s+are\s+you|your\s+name|hello|hi|hey|how\s+are\s+you|good\s+morning|good\s+evening)\b"
PART_NAMES = (("federal family education loan", "682"), ("ffel", "682"), ("direct loan", "685"))
NODE = r"(?i)p-(\d+(?:\.\d+)+(?:\([^)]+\))+)"
BARE_NODE = r"(?i)(\d+(?:\.\d+)+(?:\([^)]+\))+)"
PART = r"(?i)\b(?:34\s*cfr\s*)?part\s*(\d{3})\b"
CITATION = r"\b\d+\s*cfr\s*\d+(?:\.\d+)+\b"
SECTION = r"\b\d+(?:\.\d+)+\b"


def explicit_node_id(question: Column) -> Column:
    """``p-668.32(a)`` from the question without its white space, letters as written; '' if it names none."""
    tight = F.regexp_replace(blank(question), r"\s+", "")
    named, bare = F.regexp_extract(tight, NODE, 1), F.regexp_extract(tight, BARE_NODE, 1)
    return F.when(named != "", F.concat(F.lit("p-"), named)).when(bare != "", F.concat(F.lit("p-"), bare)).otherwise("")


def part_hint(question: Column) -> Column:
    low = F.lower(blank(question))
    out = F.when(F.regexp_extract(low, PART, 1) != "", F.regexp_extract(low, PART, 1))
    for name, part in PART_NAMES:
        out = out.when(F.contains(low, F.lit(name)), F.lit(part))
    return out.otherwise("")


def citation_ref(question: Column) -> Column:
    low = F.lower(blank(question))
    full = F.regexp_extract(low, CITATION, 0)
    return F.when(full != "", full).otherwise(F.regexp_extract(low, SECTION, 0))


def is_small_talk(question: Column) -> Column:
    """An empty question, or one with a phrase of small talk and no other letter or digit."""
    q = F.trim(F.regexp_replace(blank(question), r"\s+", " "))
    rest = F.regexp_replace(F.regexp_replace(q, SMALL_TALK, " "), "[^a-zA-Z0-9]+", "")
    return (q == "") | (q.rlike(SMALL_TALK) & (rest == ""))
