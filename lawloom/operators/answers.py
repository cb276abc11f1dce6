"""What is shown of retrieved records: labels, citations, context blocks and footers.

Nulls count as empty.  What is gathered is the top list of one question, which
its caller has bounded by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, snippet

#: Where sections are read whose records have no address; a parameter of ``inferred_url``.
BASE_URL = "https://example.org/current/title-34"
#: The number of a section, and the lines of a context block.
SECTION = r"(\d+(?:\.\d+)+)"
BLOCK = (("Section", "section_ref"), ("Source Name", "source_name"), ("Source Type", "source_type"), ("Authority Level", "authority_level"), ("Source URL", "source_url"), ("Content", "content"))
FOOTER_ITEMS = 3


def source_label(name: Column, url: Column) -> Column:
    """The name, else the address' host, else ``source``."""
    host = F.regexp_replace(F.regexp_extract(blank(url), "https?://([^/]+)", 1), r"www\.", "")
    return F.coalesce(F.nullif(F.trim(blank(name)), F.lit("")), F.nullif(host, F.lit("")), F.lit("source"))


def inferred_url(url: Column, node: Column, ref: Column, base: str = BASE_URL) -> Column:
    """The address, else one made of the section in the paragraph's id or in the reference, else ''."""
    section = F.coalesce(F.nullif(F.regexp_extract(blank(node), "p-" + SECTION, 1), F.lit("")), F.nullif(F.regexp_extract(blank(ref), SECTION, 1), F.lit("")))
    made = F.concat(F.lit(base + "/part-"), F.substring_index(section, ".", 1), F.lit("/section-"), section)
    return F.coalesce(F.nullif(F.trim(blank(url)), F.lit("")), made, F.lit(""))


def citation(name: Column, url: Column, node: Column, ref: Column) -> Column:
    """``label (address)``, or the label where no address is known."""
    at = inferred_url(url, node, ref)
    label = F.coalesce(F.nullif(F.trim(blank(ref)), F.lit("")), source_label(name, url))
    return F.when(at != "", F.concat(label, F.lit(" ("), at, F.lit(")"))).otherwise(label)


def citations(matches: DataFrame) -> DataFrame:
    """``matches`` as shown: label, address, citation and snippet of each."""
    name, url, node, ref = (F.col(c) for c in ("source_name", "source_url", "node_id", "section_ref"))
    return matches.withColumns({
        "label": source_label(name, url), "cited_url": inferred_url(url, node, ref), "citation": citation(name, url, node, ref),
        "snippet": snippet(F.trim(blank(F.col("content")))),
    })


def _in_rank(text: Column, sign: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("line")))), lambda x: x["line"]), sign)


def contexts(matches: DataFrame) -> DataFrame:
    """(question_id, context): a block for each match, in rank order; ranks count from 1 without gaps."""
    lines = [F.concat(F.lit("[SOURCE "), F.col("rank").cast("string"), F.lit("]"))]
    lines += [F.concat(F.lit(f"{k}: "), blank(F.col(c))) for k, c in BLOCK]
    return matches.groupBy("question_id").agg(_in_rank(F.concat_ws("\n", *lines), "\n\n").alias("context"))


def footers(cited: DataFrame) -> DataFrame:
    """(question_id, footer): the first FOOTER_ITEMS citations as a list."""
    line = F.concat(F.lit("- "), F.col("rank").cast("string"), F.lit(". "), F.col("citation"))
    return cited.where(F.col("rank") <= FOOTER_ITEMS).groupBy("question_id").agg(_in_rank(line, "\n").alias("footer"))


def with_footer(answer: Column, footer: Column) -> Column:
    """The answer, with the footer if it names neither an address nor a section."""
    text = F.trim(blank(answer))
    bare = ~F.lower(text).rlike("https?://") & ~F.contains(text, F.lit("§"))
    return F.when((text != "") & bare & (blank(footer) != ""), F.concat(text, F.lit("\n\nCitations:\n"), footer)).otherwise(text)


#: How an answer without a model begins, what stands where nothing was found, and the place of a source in an answer.
RETRIEVAL_HEAD = "LLM response is rate-limited. Retrieval-only result:"
UNKNOWN_ANSWER = "I\u2019m unable to provide a reliable answer from the available knowledge base. Please share more context or a source-specific question."
PLACEHOLDER = r"(?i)\[\s*source\s*(\d+)\s*\]"


def retrieval_answers(questions: DataFrame, cited: DataFrame, top_k: int = 5) -> DataFrame:
    """(question_id, answer): the first citations with snippets; UNKNOWN_ANSWER for questions without a match."""
    lines = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("citation"), F.lit("\n"), snippet(F.trim(blank(F.col("content"))), 280))
    found = cited.where(F.col("rank") <= top_k).groupBy("question_id").agg(F.concat(F.lit(RETRIEVAL_HEAD + "\n"), _in_rank(lines, "\n")).alias("answer"))
    return questions.select("question_id").join(found, "question_id", "left").select("question_id", F.coalesce("answer", F.lit(UNKNOWN_ANSWER)).alias("answer"))


def fill_placeholders(answer: Column, citations: Column) -> Column:
    """``[source n]`` becomes the n-th of an array of citations, or the word source where there is none."""
    text = blank(answer)
    # What lies between the places, and the numbers in them, in turn.
    between = F.split(text, PLACEHOLDER)
    numbers = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))
    known = lambda n: F.coalesce(F.try_element_at(citations, F.greatest(n.try_cast("int"), F.lit(1))), F.lit("source"))
    filled = F.transform(numbers, lambda n: F.when(n.try_cast("int") >= 1, known(n)).otherwise("source"))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("b"), filled.alias("f")), lambda x: F.array(x["b"], F.coalesce(x["f"], F.lit(""))))), "")
