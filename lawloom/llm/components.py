"""Connected components of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``links`` (a, b): ``comp`` is the least node that it reaches.

    Each turn takes the least label among the neighbours and then that label's
    own label, so that long chains shrink quickly; every turn is written as a
    table, whose small files Spark reads in few tasks and whose size it knows.
    Links to itself and repeated links are allowed.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = common.written(links.where("a <> b").select(F.explode(ways).alias("way")).select("way.*").distinct())
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("least")), "b").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("least"))
        step = labels.select("node", "comp").join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("further"))
        new = common.written(step.join(jump, "to", "left").select("node", "old", F.coalesce(F.least("to", "further"), "to").alias("comp")))
        common.forget(labels)
        labels = new
        common.sweep(links.sparkSession)
        if new.where("comp <> old").isEmpty():
            common.forget(both)
            return common.kept_at(new.select("node", "comp"), new)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``labels`` and of further ``links`` (a, b) between its components, by work on the new links alone.

    A node without a label is a component of its own.
    """
    upper = components(links)
    # A component's label is its least node, so a node that was known may come from both sides, equal.
    every = labels.join(upper.toDF("comp", "top"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    out = common.written(every.unionByName(upper).distinct())
    common.forget(upper)
    return out


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``merged`` for ``links`` (a, b) between nodes."""
    ends = links.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
    found = merged(labels, ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    # Of links to itself no node came in.
    own = [links.select(F.col(c).alias("node"), F.col(c).alias("comp")) for c in ("a", "b")]
    return common.written(found.unionByName(own[0]).unionByName(own[1]).groupBy("node").agg(F.min("comp").alias("comp")))
