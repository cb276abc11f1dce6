"""The command line: ``python -m lawloom ingest|query|ask|chunk``.

ingest checks records and vectors, writes them as an index and prints its
counts; query and ask read an index, or records (and, if given, vectors) from
Parquet, and print what they find for each question; chunk reads paragraphs of
sections and writes their chunks as JSON and as a report for readers.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import answers, asking, ingest, logical

#: Columns of records beside doc_id; those that a file lacks are null.
RECORD = ("content", "node_id", "part", "section_ref", "source_name", "source_type", "source_url", "authority_level")
SNIPPET = 160


def _records(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[F.col(c).cast("string").alias(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in RECORD])


def _questions(spark: SparkSession, texts: list[str], vectors: str | None) -> DataFrame:
    """The questions, numbered from 1; ``vectors`` has question_id and vector."""
    asked = spark.createDataFrame(list(enumerate(texts, 1)), "question_id long, question string")
    if vectors:
        return asked.join(spark.read.parquet(vectors).select("question_id", "vector"), "question_id", "left")
    return asked.withColumn("vector", F.lit(None).cast("array<double>"))


def main(argv: list[str] | None = None) -> list[str]:
    """Runs one command and prints its lines, which it also returns."""
    parser = argparse.ArgumentParser(prog="lawloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("query", "ask"):
        command = commands.add_parser(name)
        source = command.add_mutually_exclusive_group(required=True)
        source.add_argument("--index", help="a folder that ingest wrote")
        source.add_argument("--records")
        command.add_argument("--vectors", help="Parquet with doc_id and vector, beside --records")
        command.add_argument("--question-vectors", help="Parquet with question_id and vector")
        command.add_argument("--top-k", type=int, default=5, choices=range(1, 26), metavar="1-25")
        command.add_argument("question", nargs="+")
    command = commands.add_parser("ingest")
    command.add_argument("--records", required=True, help="Parquet with doc_id, content and more")
    command.add_argument("--vectors", required=True, help="Parquet with doc_id and vector")
    command.add_argument("--out", required=True, help="a new folder")
    command.add_argument("--previous", help="an index whose records stay where no new ones come")
    command.add_argument("--order", help="the column that tells which of repeated records is the last")
    command = commands.add_parser("chunk")
    command.add_argument("--paragraphs", required=True, help="Parquet with doc_id, section, n, node_id and text")
    command.add_argument("--out", required=True)
    for name, size in (("least", 200), ("most", 1400), ("overlap", 200)):
        command.add_argument(f"--{name}", type=int, default=size)
    args = parser.parse_args(argv)
    if args.command in ("query", "ask"):
        if not all(q.strip() for q in args.question):
            parser.error("a question is empty")
        if args.index and args.vectors:
            parser.error("an index has vectors of its own")
    if args.command == "ingest" and args.out == args.previous:
        parser.error("an index can't be written over the one it is made from")

    spark = SparkSession.builder.appName("lawloom").getOrCreate()
    if args.command == "ingest":
        counts = ingest.ingest(spark.read.parquet(args.records), spark.read.parquet(args.vectors), args.out, args.previous, order=args.order)
        lines = [f"{name}: {n}" for name, n in counts.first().asDict().items()]
    elif args.command == "chunk":
        placed = logical.logical_chunks(spark.read.parquet(args.paragraphs), args.least, args.most, args.overlap)
        placed.write.mode("overwrite").json(f"{args.out}/chunks")
        # Written once, read again: the report needs no second cutting.
        logical.chunk_report(spark.read.schema(placed.schema).json(f"{args.out}/chunks")).select("report").write.mode("overwrite").text(f"{args.out}/report")
        lines = [f"written: {args.out}"]
    else:
        asked = _questions(spark, args.question, args.question_vectors)
        if args.index:
            found, vectors = ingest.open_index(spark, args.index)
            records, keywords = _records(found), f"{args.index}/keywords"
        else:
            records, keywords = _records(spark.read.parquet(args.records)), None
            kind = dict(records.dtypes)["doc_id"]
            vectors = spark.read.parquet(args.vectors) if args.vectors else spark.createDataFrame([], f"doc_id {kind}, vector array<double>")
        matches = asking.semantic_query(asked, records, vectors.select("doc_id", "vector"), args.top_k, keywords=keywords)
        if args.command == "ask":
            lines = [r.answer for r in asking.answer(asked, matches).orderBy("question_id").collect()]
        else:
            shown = answers.citations(matches).orderBy("question_id", "rank")
            text = F.substring(F.regexp_replace("snippet", r"\s+", " "), 1, SNIPPET)
            lines = [f"{r.question_id}.{r.rank} {r.final:.4f} {r.citation}: {r.t}" for r in shown.select("question_id", "rank", "final", "citation", text.alias("t")).collect()]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
