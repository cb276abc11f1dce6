"""The tree of a section's paragraphs, and the text below each of its nodes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, node_path


def section_tree(rows: DataFrame, by: str, node_id: str = "node_id", pos: str = "n", text: str = "text") -> DataFrame:
    """(by, path, seq, node_id, text): every node of each ``by``, ancestors that no paragraph has too.

    A paragraph's path is the labels in its id, none for the section itself and
    for other ids.  Of several paragraphs of a node the last text that is not
    blank stands.  ``seq`` counts from 0 in the order of the paths, parents first.
    """
    full = rows.withColumn("_path", node_path(F.col(node_id)))
    each = full.select(by, pos, node_id, text, "_path", F.explode(F.sequence(F.lit(0), F.size("_path"))).alias("_d"))
    own = F.col("_d") == F.size("_path")
    last = lambda c: F.coalesce(F.max_by(c, F.when(own & (F.trim(blank(F.col(c))) != ""), F.col(pos))), F.lit(""))
    grouped = each.groupBy(by, F.slice("_path", F.lit(1), F.col("_d")).alias("path")).agg(last(node_id).alias("node_id"), last(text).alias("text"))
    order = Window.partitionBy(by).orderBy("path")
    return grouped.select(by, "path", (F.row_number().over(order) - 1).alias("seq"), "node_id", "text")


class _Node(NamedTuple):
    by: object
    path: list[str]
    seq: int
    parts: list[str]
    low: list[str]


def _rolled_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sections in the order of their paths to the same nodes with all text below; open are a node and its ancestors only."""
    above: list[_Node] = []
    schema = None

    def close(done: list[tuple]) -> None:
        node = above.pop()
        text = "\n".join(node.parts)
        done.append((node.by, node.path, node.seq, text))
        if text and above and above[-1].by == node.by and text.lower() not in above[-1].low[0]:
            above[-1].parts.append(text)
            above[-1].low[0] += " " * bool(above[-1].low[0]) + text.lower()

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(schema)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema.names)

    for batch in batches:
        schema, done = batch.schema, []
        for by, path, seq, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            while above and (above[-1].by != by or path[: len(above[-1].path)] != above[-1].path):
                close(done)
            above.append(_Node(by, path, seq, [text] if text else [], [text.lower()]))
        yield rows(done)
    done = []
    while above:
        close(done)
    if done:
        yield rows(done)


def subtree_texts(tree: DataFrame, by: str) -> DataFrame:
    """(by, path, seq, text): of each node of a ``section_tree`` its text and that of all below, children in the order of their labels.

    A child whose text the text so far has, whatever its case, is left out.
    Nodes are read in the order of their paths, so one pass with the open
    branch in memory is enough; it stays where the tree is, without a shuffle.
    """
    # The number that the pass hands on makes sure of that order.
    order = F.row_number().over(Window.partitionBy(by).orderBy("path")) - 1
    ordered = tree.select(by, "path", order.alias("seq"), "text")
    kind = dict(tree.dtypes)[by]
    return ordered.mapInArrow(_rolled_up, f"`{by}` {kind}, path array<string>, seq int, text string")


def level_chunks(rows: DataFrame, by: str, section: str, node_id: str = "node_id", pos: str = "n", text: str = "text") -> DataFrame:
    """(by, section, chunk_id, path, seq, depth, text): a chunk for each node with text below it, the section itself left out.

    A ``by`` without such a node has its paragraphs as chunks, under ``p`` and
    their place.
    """
    labelled = (F.size(node_path(F.col(node_id))) > 0) & (F.trim(blank(F.col(text))) != "")
    whole = Window.partitionBy(by)
    rows = rows.withColumn("_labels", F.max(labelled).over(whole))
    nodes = subtree_texts(section_tree(rows, by, node_id, pos, text), by).where((F.size("path") > 0) & (F.col("text") != ""))
    bare = rows.where(~F.col("_labels") & (F.trim(blank(F.col(text))) != ""))
    bare = bare.select(by, F.array(F.concat(F.lit("p"), F.col(pos).cast("string"))).alias("path"), F.col(pos).cast("int").alias("seq"), F.col(text).alias("text"))
    both = nodes.unionByName(bare).join(rows.groupBy(by).agg(F.min(section).alias("section")), by)
    name = F.concat(F.col("section"), F.lit(":"), F.array_join("path", "/"))
    return both.select(by, "section", name.alias("chunk_id"), "path", "seq", F.size("path").alias("depth"), "text")
