"""Connected components of an edge table as rounds of joins and aggregates (no collect).

Every node hooks to the least of its lesser neighbours (a map-side combined minimum), labels
jump one pointer further, and the edges are contracted to their ends' labels, until no edge is
left. A star of any size is gone after one round and a path is halved by each, so rounds grow
with the logarithm of the longest path and tables shrink from round to round. Joins on a hub
are between written tables, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscope.llm.common import stored

BROADCAST_ROWS = 200_000  # rows of (node, node) broadcast at most: a few MB


def small(df: DataFrame) -> DataFrame:
    """``df`` (written data) with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def relabel(df: DataFrame, node: str, labels: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: the label of ``node``, which is its own if it has none."""
    return (
        df.join(labels.select(F.col("node").alias("_node"), F.col("label").alias("_label")), F.col(node) == F.col("_node"), "left")
        .withColumn(out, F.coalesce("_label", F.col(node)))
        .drop("_node", "_label")
    )


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of an edge; root is the least node of the component.

    Loops, repeated and reversed edges are fine; an edge with a null end is ignored; no edges
    give no rows.
    """
    x, y = F.col(a), F.col(b)
    e = stored(
        edges.where(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges"
    )
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    open_ = e.where("a != b")
    while not open_.isEmpty():
        hook = stored(open_.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "hooks")
        labels = small(stored(relabel(hook.withColumnRenamed("label", "_hook"), "_hook", small(hook), "label").drop("_hook"), "labels"))
        nodes = relabel(nodes, "root", labels, "root")
        both = relabel(relabel(open_, "a", labels, "a"), "b", labels, "b")
        both = both.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        open_ = stored(both, "contracted")
    return nodes
