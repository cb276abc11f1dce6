"""A keyword index that grows: segments of postings, removals, statistics over what lives, compaction.

Each batch of texts is a segment of its own, which nothing changes any more.  A
key that comes again, or is removed, is dead in all segments before; how many
texts there are, their mean length and the documents of a term are sums over
what lives, so they are always those of an index made anew.  The list of
segments is written last: a segment that isn't in it was never there.

Postings are packed: a row holds those of one term in one block of documents of
like length, with the greatest frequency and the least length among them.  No
document of a block can score more than these two would give it, whatever the
statistics are by then, so a search for the best few can open the most promising
blocks first, and then only those that could hold something better than what
these gave.  The rows lie in folders by the hash of their term, so that a question
opens its own, and in each file by the grade of length, so that Parquet skips
what has none of the blocks.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import search_tokens
from . import bm25
from .lineage import cut

#: Folders of one segment's postings.
BUCKETS = 64
#: Documents and words of a block, about; documents for which a folder has a file more.
BLOCK_DOCS, BLOCK_WORDS, FILE_DOCS = 64, 500_000, 2_000_000
#: Scores are ranked by six digits: so far below the last of the best a bound may lie and still matter.
MARGIN = 1e-5
ADDED, REMOVED, COMPACTED = "added", "removed", "compacted"
MANIFEST = "segment long, kind string"
#: A segment's postings; one of empty texts has no file to read that from.
PACKED = "term string, block long, n long, most_tf long, least_dl int, hits array<struct<{key} {kind}, tf: long, dl: int>>, grade int, bucket int"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of an index, if it is there."""
    files, at = _folder(spark, path)
    files.delete(at, True)


def _segments(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The segments that count, in order: one row for each batch since the last compaction, however many texts there are."""
    files, at = _folder(spark, f"{path}/manifest")
    if not files.exists(at):
        return []
    rows = sorted((r.segment, r.kind) for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").distinct().collect())
    last = max((n for n, kind in rows if kind == COMPACTED), default=0)
    return [(n, kind) for n, kind in rows if n >= last]


def _listed(spark: SparkSession, path: str, segment: int, kind: str) -> int:
    spark.createDataFrame([(segment, kind)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return segment


def _next(spark: SparkSession, path: str) -> int:
    return max((n for n, _ in _segments(spark, path)), default=0) + 1


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _grade(dl: Column) -> Column:
    """Documents of one grade are within a factor of two in length."""
    return F.floor(F.log2(dl + 1.0)).cast("int")


def _placed(rows: DataFrame, dl: Column, lengths: DataFrame, key: str) -> DataFrame:
    """``rows`` with their grade and block, where all of a block meet in one task."""
    size = F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("dl") / BLOCK_WORDS)
    blocks = lengths.groupBy(_grade(F.col("dl")).alias("grade")).agg(F.greatest(F.ceil(size), F.lit(1)).alias("_blocks"))  # 32 rows at most
    found = rows.withColumn("grade", _grade(dl)).join(F.broadcast(blocks), "grade")
    return found.withColumn("block", F.pmod(F.xxhash64(key), F.col("_blocks"))).drop("_blocks").repartition("grade", "block")


def _write_packed(found: DataFrame, n_docs: int, at: str, key: str) -> None:
    """Writes the postings (grade, block, key, term, tf, dl) of a segment, which were placed, so that they are packed where they are."""
    packed = found.groupBy("grade", "block", "term").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.collect_list(F.struct(key, "tf", "dl")).alias("hits")
    )
    # A frequent term's blocks are dealt over as many tasks as the documents need.
    dealt = packed.withColumns({"bucket": _bucket(F.col("term")), "_file": F.pmod(F.col("block"), F.lit(1 + n_docs // FILE_DOCS))}).repartition("bucket", "_file")
    dealt.drop("_file").sortWithinPartitions("bucket", "grade", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")


def add(docs: DataFrame, path: str, key: str, text: str, order: str | None = None, tokenizer: bm25.Tokenizer = search_tokens) -> int:
    """Adds (key, text) rows as a segment, in place of what their keys had; its number.

    Rows with a null or blank key are skipped; null texts have no words, but
    count.  Of a key's rows the last by ``order`` stands; without it a key comes
    once.  A segment that was begun and not finished is written over.
    """
    spark = docs.sparkSession
    rows = docs.where(F.trim(F.col(key).cast("string")) != "").select(key, F.col(text).alias("text"), *([F.col(order).alias("o")] if order else []))
    if order:
        rows = rows.groupBy(key).agg(F.max(F.struct("o", "text"))["text"].alias("text"))
    segment = _next(spark, path)
    at = f"{path}/segment-{segment}"
    rows.select(key, F.size(tokenizer(F.col("text"))).alias("dl")).write.mode("overwrite").parquet(f"{at}/lengths")
    lengths = spark.read.parquet(f"{at}/lengths")
    # Texts travel, once; their postings, which are more, are counted and packed where their block is.
    tokens = _placed(rows, F.size(tokenizer(F.col("text"))), lengths, key).select(key, "grade", "block", tokenizer(F.col("text")).alias("tokens"))
    each = tokens.select(key, "grade", "block", F.explode("tokens").alias("term"), F.size("tokens").alias("dl"))
    _write_packed(each.groupBy("grade", "block", key, "term", "dl").agg(F.count(F.lit(1)).alias("tf")), lengths.count(), at, key)
    return _listed(spark, path, segment, ADDED)


def remove(keys: DataFrame, path: str, key: str) -> int:
    """Removes keys, those that aren't there too; the number of the segment that says so."""
    spark = keys.sparkSession
    segment = _next(spark, path)
    keys.select(key).where(F.col(key).isNotNull()).distinct().write.mode("overwrite").parquet(f"{path}/segment-{segment}/removed")
    return _listed(spark, path, segment, REMOVED)


def _read(spark: SparkSession, path: str, listed: list[tuple[int, str]], kinds: tuple[str, ...], what: str) -> DataFrame | None:
    """(segment, ...) of all segments of some kinds."""
    out = None
    for n, kind in listed:
        if kind in kinds:
            at = f"{path}/segment-{n}"
            reader = spark.read
            if what == "postings":
                ((key, kind),) = [(f"`{c}`:", t) for c, t in spark.read.parquet(f"{at}/lengths").dtypes if c != "dl"]
                reader = reader.schema(PACKED.format(key=key, kind=kind))
            rows = reader.parquet(f"{at}/{what}").withColumn("segment", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
    return out


def _ended(spark: SparkSession, path: str, key: str, listed: list[tuple[int, str]]) -> DataFrame | None:
    """(_key, last): what keys had in segments before ``last`` is dead; few keys beside all, of which only their segments' numbers are compared."""
    if len(listed) < 2:
        return None
    events = _read(spark, path, listed, (ADDED, COMPACTED), "lengths").select(key, "segment")
    gone = _read(spark, path, listed, (REMOVED,), "removed")
    ended = events.unionByName(gone.select(key, "segment")) if gone is not None else events
    return ended.groupBy(key).agg(F.max("segment").alias("last"), F.min("segment").alias("first")).where("first < last").select(F.col(key).alias("_key"), "last")


def _alive(rows: DataFrame, ended: DataFrame | None, key: str, how: str = "left_anti") -> DataFrame:
    return rows if ended is None else rows.join(ended, (F.col(key) == F.col("_key")) & (F.col("segment") < F.col("last")), how)


def _held(spark: SparkSession, path: str, listed: list[tuple[int, str]], what: str) -> DataFrame:
    rows = _read(spark, path, listed, (ADDED, COMPACTED), what)
    if rows is None:
        raise ValueError(f"no keyword index under {path}")
    return rows


def _living_lengths(spark: SparkSession, path: str, key: str) -> DataFrame:
    listed = _segments(spark, path)
    return _alive(_held(spark, path, listed, "lengths"), _ended(spark, path, key, listed), key).drop("segment")


def size(spark: SparkSession, path: str, key: str) -> int:
    return _living_lengths(spark, path, key).count()


def _unpacked(packed: DataFrame, *others: str) -> DataFrame:
    """(segment, term, others, key, tf, dl): a row for each posting."""
    return packed.select("segment", "term", *others, F.inline("hits"))


def search(questions: DataFrame, path: str, key: str, top_k: int | None = 10, min_score: float = 0.0, within: DataFrame | None = None, tokenizer: bm25.Tokenizer = search_tokens, bounded: bool = False) -> DataFrame:
    """What ``bm25.search`` gives over the texts that live; with ``within`` (key), only those are listed, and the statistics stay those of all.  ``tokenizer`` is that of the texts.

    It takes every posting of the questions' terms.  With ``bounded`` the best
    ``top_k`` of all are sought block by block (``_best``), in two rounds, which
    gives the same rows: it unpacks less the shorter the questions are, and the
    more documents there are for each of the best.
    """
    spark = questions.sparkSession
    listed = _segments(spark, path)
    terms = bm25._terms(questions, tokenizer)
    opened = [r.b for r in terms.select(_bucket(F.col("term")).alias("b")).distinct().collect()]  # BUCKETS numbers at most
    few = bm25._few(terms)
    wanted = bm25._wanted(terms, few)
    packed = _held(spark, path, listed, "postings").where(F.col("bucket").isin(opened)).join(wanted, "term", "left_semi")
    ended = _ended(spark, path, key, listed)
    stats = _alive(_held(spark, path, listed, "lengths"), ended, key).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(F.col("dl").cast("double")), F.lit(0.0)).alias("avgdl"))
    if bounded:
        if within is not None or top_k is None:
            raise ValueError("bounds are for the best few of all texts")
        df = packed.groupBy("term").agg(F.sum("n").alias("df"))
        if ended is not None:
            dead = _alive(_unpacked(packed), ended, key, "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_dead"))
            df = df.join(dead, "term", "left").select("term", (F.col("df") - F.coalesce("_dead", F.lit(0))).alias("df")).where("df > 0")
        weighed = cut(bm25.weighed(terms, df, stats))
        return _best(_held(spark, path, listed, "postings").where(F.col("bucket").isin(opened)), weighed, few, ended, key, top_k, min_score)
    found = _alive(_unpacked(packed), ended, key).drop("segment")
    if within is None:
        return bm25._of_postings(terms, found, stats, key, top_k, min_score, few)
    scored = bm25._of_postings(terms, found, stats, key, None, min_score, few).drop("rank")
    return bm25.ranked(scored.join(within.select(key), key, "left_semi"), key, top_k)


BLOCK = ("segment", "grade", "block")


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= bm25.BROADCAST_TERMS else rows


def _opened(packed: DataFrame, asked: DataFrame) -> DataFrame:
    """The folders and grades of ``packed`` that have what is ``asked`` (term, grade): at most BUCKETS numbers for each of 32 grades."""
    folders: dict[int, list[int]] = {}
    for r in asked.select("grade", _bucket(F.col("term")).alias("bucket")).distinct().collect():
        folders.setdefault(r.grade, []).append(r.bucket)
    some = [(F.col("grade") == grade) & F.col("bucket").isin(sorted(buckets)) for grade, buckets in sorted(folders.items())]
    return packed.where(reduce(or_, some, F.lit(False)))


def _best(packed: DataFrame, weighed: DataFrame, few: bool, ended: DataFrame | None, key: str, top_k: int, min_score: float) -> DataFrame:
    """The best ``top_k`` of each question, from blocks of postings and the questions' ``weighed`` terms.

    A block's bound is what its greatest frequencies and least lengths would
    score.  The ``top_k`` blocks with the greatest bounds are scored first; the
    last of their best is a score that the final best reach in any case, so
    blocks with a bound below it stay closed.  What has died only makes a bound
    too great, never too small.
    """
    sent = F.broadcast if few else lambda rows: rows
    heads, own = packed.select(*BLOCK, "term", "most_tf", "least_dl"), sent(weighed)
    bounds = heads.join(own, "term").groupBy("question_id", *BLOCK).agg(F.sum(bm25.contribution(F.col("most_tf"), F.col("least_dl"))).alias("bound"))

    def scores(blocks: DataFrame) -> DataFrame:
        blocks = cut(blocks.select("question_id", *BLOCK))
        asked = blocks.join(own, "question_id")
        # A block's postings meet in one task, where a document's score is whole.
        rows = _opened(packed, asked).repartition(*BLOCK).join(_sent(asked), [*BLOCK, "term"])
        hits = rows.select("question_id", *BLOCK, "qtf", "idf", "avgdl", F.inline("hits"))
        scored = _alive(hits, ended, key).groupBy("question_id", *BLOCK, key).agg(F.sum(bm25.contribution(F.col("tf"), F.col("dl"))).alias("score"))
        return bm25.ranked(scored.select("question_id", key, "score").where((F.col("score") > 0) & (F.col("score") >= min_score)), key, top_k)

    promising = bounds.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("bound"), *BLOCK))).where(F.col("_n") <= top_k)
    reached = cut(scores(promising).where(F.col("rank") == top_k).select("question_id", F.col("score").alias("reached")))
    least = F.greatest(F.coalesce("reached", F.lit(0.0)), F.lit(float(min_score)))
    return scores(bounds.join(sent(reached), "question_id", "left").where(F.col("bound") >= least - MARGIN))


def compact(spark: SparkSession, path: str, key: str) -> int:
    """Writes what lives as one segment, which stands for all before; its number."""
    segment = _next(spark, path)
    at = f"{path}/segment-{segment}"
    listed = _segments(spark, path)
    _living_lengths(spark, path, key).write.mode("overwrite").parquet(f"{at}/lengths")
    found = _alive(_unpacked(_held(spark, path, listed, "postings")), _ended(spark, path, key, listed), key).drop("segment")
    lengths = spark.read.parquet(f"{at}/lengths")
    _write_packed(_placed(found, F.col("dl"), lengths, key), lengths.count(), at, key)
    return _listed(spark, path, segment, COMPACTED)
