"""Exact cosine search of query vectors against all vectors, or against those of a scope that each query names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Queries and vectors in one tile; every query meets every vector of its scope in one of the tiles.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 4096
#: So many scopes that are asked for are sent to every task; more are joined by a shuffle, each spread over SALTS keys.
BROADCAST_SCOPES, SALTS = 100_000, 32
#: Folders of a saved table of vectors.
BUCKETS = 64
#: Queries of a tile that are multiplied with its vectors at once.
QUERY_ROWS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def check_dimension(vectors: DataFrame, vector: str = "vector") -> int:
    """The one dimension of all vectors; an error if they have several."""
    found = vectors.where(F.col(vector).isNotNull()).agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if found.a != found.b:
        raise ValueError(f"vectors of {found.a} to {found.b} dimensions")
    return found.a or 0


def _unit(vectors: pa.Array, size: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return flat / np.maximum(np.sqrt((flat * flat).sum(1, keepdims=True)), 1e-300)


def _places(rows: DataFrame, scopes: tuple[str, ...]) -> Column:
    """Scopes of a row as (level, mark), the first of ``scopes`` at level 0; blank ones are none."""
    of = [F.struct(F.lit(i).alias("level"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("mark")) for i, c in enumerate(scopes)]
    return F.filter(F.array(*of), lambda x: x["mark"] != "") if of else F.array().cast("array<struct<level:int,mark:string>>")


def nearest(queries: DataFrame, vectors: DataFrame, top_k: int, key: str = "vec_id", scopes: tuple[str, ...] = ()) -> DataFrame:
    """(question_id, key, score, rank): the stated queries (question_id, vector) against ``vectors`` (key, vector).

    ``scopes`` names columns that both sides have: a query takes only vectors of
    its first scope that any vector fits (not blank, and equal), else all of
    them, and ``branch`` says which.  Both sides of a scope come in tiles of
    bounded size, so a query meets its own scope's vectors alone, and a vector
    of a scope that nobody asks for stays where it is; each tile keeps the best
    of each query, and the tiles' lists are merged.  Ties go to the smaller key;
    null vectors are left out.  Ids may have any type that has an order.
    """
    return _nearest(queries, vectors, vectors, check_dimension(vectors), top_k, key, scopes)


def _nearest(queries: DataFrame, vectors: DataFrame, scoped: DataFrame, size: int, top_k: int, key: str, scopes: tuple[str, ...]) -> DataFrame:
    """``nearest`` for vectors of ``size`` dimensions, where ``scoped`` has at least those of ``vectors`` whose scopes are asked for."""
    queries, vectors, scoped = (x.where(F.col("vector").isNotNull()) for x in (queries, vectors, scoped))
    kinds = dict(queries.dtypes)["question_id"], dict(vectors.dtypes)[key]
    none = [F.lit(None).cast(k) for k in kinds]
    last = len(scopes)

    # Which scope a query takes, and how many tiles each scope has.
    asked = queries.select(F.col("question_id").alias("qid"), "vector", _places(queries, scopes).alias("places"))
    wanted = asked.select(F.explode("places").alias("p")).select("p.*").distinct()
    sizes = scoped.select(F.explode(_places(scoped, scopes)).alias("p")).select("p.*").groupBy("level", "mark").agg(F.count(F.lit(1)).alias("n"))
    known = cut(sizes.join(wanted, ["level", "mark"], "left_semi"))
    few = known.count() <= BROADCAST_SCOPES
    hint = F.broadcast if few else lambda rows: rows
    first = asked.select("qid", F.explode("places").alias("p")).select("qid", "p.*").join(hint(known), ["level", "mark"])
    first = first.groupBy("qid").agg(F.min(F.struct("level", "mark")).alias("p")).select(F.col("qid").alias("_qid"), "p.*")
    placed = asked.drop("places").join(first, F.col("qid") == F.col("_qid"), "left").drop("_qid").fillna({"level": last, "mark": ""})
    loads = cut(placed.groupBy("level", "mark").agg(F.count(F.lit(1)).alias("m")))
    tiles = lambda n, block: F.ceil(F.col(n) / block).cast("int")
    plan = loads.join(hint(known), ["level", "mark"]).select("level", "mark", tiles("m", QUERY_BLOCK).alias("tq"), tiles("n", VECTOR_BLOCK).alias("tv"))
    whole = loads.where(F.col("level") == last).first()  # one row at most
    n_all = vectors.count() if whole else 0

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asks = lambda rows: rows.select(F.lit(True).alias("asks"), "qid", none[1].alias("vid"), "vector", "level", "mark", number("qid", "tq").alias("q"), every("tv").alias("v"))
    gives = lambda rows: rows.select(F.lit(False).alias("asks"), none[0].alias("qid"), "vid", "vector", "level", "mark", every("tq").alias("q"), number("vid", "tv").alias("v"))

    def spread(rows: DataFrame, by: str) -> DataFrame:
        """Rows of scopes with the tiles of these; a scope of very many rows has many keys."""
        if few:
            return rows.join(F.broadcast(plan), ["level", "mark"])
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, ["level", "mark", "salt"])

    own = scoped.select(F.col(key).alias("vid"), "vector", F.explode(_places(scoped, scopes)).alias("p")).select("vid", "vector", "p.*")
    sides = asks(spread(placed, "qid")).unionByName(gives(spread(own, "vid")))
    if whole and n_all:
        counts = {"tq": F.lit(-(-whole.m // QUERY_BLOCK)), "tv": F.lit(-(-n_all // VECTOR_BLOCK))}
        rest = vectors.select(F.col(key).alias("vid"), "vector", F.lit(last).alias("level"), F.lit("").alias("mark"))
        sides = sides.unionByName(asks(placed.where(F.col("level") == last).withColumns(counts))).unionByName(gives(rest.withColumns(counts)))

    def tile(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy(zero_copy_only=False)
        # Without vectors there is no dimension either.
        unit = _unit(table["vector"].combine_chunks(), size) if size and table.num_rows else np.zeros((table.num_rows, 0))
        rows = np.flatnonzero(~asks)
        # In the order of ids of any type, so that places stand for them.
        rows = rows[pc.sort_indices(table["vid"].take(rows)).to_numpy()]
        asked = np.flatnonzero(asks)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for some in np.split(asked, range(QUERY_ROWS, len(asked), QUERY_ROWS)):
            for q, score in zip(some.tolist(), unit[some] @ unit[rows].T, strict=True):
                rounded, at = np.round(score, 6), np.arange(len(rows))
                # A bit more than the best, as rounding makes ties.
                if len(at) > top_k:
                    least = np.partition(rounded, len(at) - top_k)[len(at) - top_k]
                    at = at[rounded >= least - 2e-6]
                    at = at[np.lexsort((at, -rounded[at]))][: 2 * top_k]
                found.append((np.full(len(at), q), rows[at], score[at]))
        q, v, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        level = table["level"].take(q).cast(pa.int32())
        return pa.table({"question_id": table["qid"].take(q), key: table["vid"].take(v), "score": pa.array(score, pa.float64()), "branch": level})

    found = sides.groupBy("level", "mark", "q", "v").applyInArrow(tile, f"question_id {kinds[0]}, {key} {kinds[1]}, score double, branch int")
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 6)), F.col(key))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked if scopes else ranked.drop("branch")


def _bucket(mark: Column) -> Column:
    return F.pmod(F.xxhash64(mark), F.lit(BUCKETS)).cast("int")


def save(vectors: DataFrame, path: str, key: str, scope: str) -> None:
    """Writes (key, vector, scope) as a table in folders by the hash of the scope, in place of what is there.

    A scope of very many vectors has several files.
    """
    check_dimension(vectors)
    rows = vectors.where(F.col("vector").isNotNull()).select(key, "vector", F.coalesce(F.col(scope).cast("string"), F.lit("")).alias(scope))
    rows = rows.withColumn("bucket", _bucket(F.col(scope)))
    rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions("bucket", scope).write.mode("overwrite").partitionBy("bucket").parquet(path)


def nearest_saved(queries: DataFrame, path: str, top_k: int, key: str, scope: str) -> DataFrame:
    """What ``nearest`` gives with one scope, from a table that ``save`` wrote.

    Only folders of scopes that are asked for are opened, and all of them once
    for queries that name no scope or one without vectors.
    """
    spark: SparkSession = queries.sparkSession
    table = spark.read.parquet(path)
    marks = queries.where(F.coalesce(F.col(scope).cast("string"), F.lit("")) != "")
    opened = [r.b for r in marks.select(_bucket(F.col(scope).cast("string")).alias("b")).distinct().collect()]  # BUCKETS numbers at most
    some = table.select(F.size("vector").alias("n")).first()  # all have one dimension, as they were checked when written
    return _nearest(queries, table.drop("bucket"), table.where(F.col("bucket").isin(opened)).drop("bucket"), some.n if some else 0, top_k, key, (scope,))
