"""Connected components by repeated contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(a long, b long) undirected edges -> (node, label): label is the smallest node reachable.

    Every round points each node at its smallest neighbour, shortens the pointers and contracts the
    edges. A node is only ever merged into a smaller one, so what is left of a component is its
    smallest node. Aggregates are partial before each shuffle, and the joins leave a hot node's rows to
    adaptive skew handling. No edges give no rows; loops and repeated edges change nothing.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = ws.keep(pairs.distinct(), f"{name}-edges-0")
    labels, step = None, 0
    while live.take(1):
        step += 1
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        point = point.select("node", F.least("node", "b").alias("to"))
        point = ws.keep(_jump(ws.keep(point, f"{name}-first-{step}")), f"{name}-point-{step}")
        moved = _relabel(_relabel(live, "a", point), "b", point).where("a <> b")
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        live = ws.keep(moved, f"{name}-edges-{step}")
        if labels is None:
            labels = point.select("node", F.col("to").alias("label"))
        else:
            labels = ws.keep(_relabel(labels, "label", point), f"{name}-labels-{step}")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def _jump(point: DataFrame) -> DataFrame:
    """Each pointer replaced by the pointer of its target."""
    return _relabel(point, "to", point)


def _relabel(df: DataFrame, column: str, point: DataFrame) -> DataFrame:
    """df with column replaced by where point leads it, if anywhere."""
    to = point.select(F.col("node").alias("_from"), F.col("to").alias("_to"))
    out = df.join(to, df[column] == to["_from"], "left")
    return out.withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
