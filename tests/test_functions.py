"""Golden values of the text and intent expressions."""

from pyspark.sql import functions as F

from lawloom.functions import intent, text
from lawloom.operators import chunks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_clean_text(spark):
    assert one(spark, text.clean_text(F.lit("( a )  ( 1 )  The school , or part ."))) == "(a) (1) The school, or part."
    assert one(spark, text.clean_text(F.lit(None).cast("string"))) == ""


def test_section_ref(spark):
    assert one(spark, text.section_ref(F.lit("668.14"), F.array(F.lit("a"), F.lit("1")))) == "§668.14(a)(1)"
    assert one(spark, text.section_ref(F.lit("668.14"), F.array(F.lit("p"), F.lit("1")))) == "§668.14(1)"
    assert one(spark, text.section_ref(F.lit("unknown"), F.array(F.lit("a")))) == ""


def test_intent(spark):
    for question, node, part, ref in (
        ("what is p-668.32(e)(5)(ii)", "p-668.32(e)(5)(ii)", "", "668.32"),
        ("34 CFR 668.32 (a)", "", "", "34 cfr 668.32"),
        ("34 CFR Part 668", "", "668", ""),
        ("ffel rules", "", "682", ""),
        ("part 6680", "", "", ""),
    ):
        q = F.lit(question)
        if node:
            assert one(spark, intent.explicit_node_id(q)) == node
        assert (one(spark, intent.part_hint(q)), one(spark, intent.citation_ref(q))) == (part, ref)


def test_small_talk(spark):
    for question, expected in (("", True), ("Hello!", True), ("Who are you?", True), ("hey, good morning", True), ("hi there", False), ("hello what is aid", False)):
        assert one(spark, intent.is_small_talk(F.lit(question))) is expected


def test_paragraph_ids(spark):
    given = [(1, 1, "( a ) ( 1 ) Text"), (1, 2, " "), (1, 3, "Lead."), (1, 4, "More (b)"), (1, 5, "More (b)"), (2, 1, None), (2, 2, "(b)(2)"), (2, 3, "Last")]
    rows = chunks.paragraph_ids(spark.createDataFrame(given, "s int, n int, text string").withColumn("sec", F.lit("668.1")), "s", "sec", "n", "text")
    want = {(1, 1): "p-668.1(a)(1)", (1, 3): "p-668.1", (1, 4): "p-668.1(p4)", (1, 5): "p-668.1(p5)", (2, 2): "p-668.1(b)(2)", (2, 3): "p-668.1"}
    assert {(r.s, r.n): r.node_id for r in rows.collect()} == want
    bodies = {r.s: r.body for r in chunks.readable(rows.withColumn("h", F.when(F.col("s") == 1, "Head")), "s", "h", "n", "text").collect()}
    assert bodies[1].startswith("Head\n\n[p-668.1(a)(1)]\n(a) (1) Text\n\n[p-668.1]\nLead.\n\n") and bodies[2] == "[p-668.1(b)(2)]\n(b)(2)\n\n[p-668.1]\nLast\n\n"


def test_base_chunks_without_tokens(spark):
    rows = spark.createDataFrame([(1, "a", 1, " "), (1, "b", 2, ""), (2, "c", 1, "one word"), (2, "d", 2, "")], "doc_id int, chunk_id string, depth int, text string")
    assert {r.chunk_id for r in chunks.base_chunks(rows).collect()} == {"b", "c"}
