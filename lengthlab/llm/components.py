"""Connected components of an edge table by repeated contraction, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lengthlab.llm.common import discard, materialise


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b; loops and nulls go."""
    return (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("keep"))
        .where("keep")
        .select("a", "b")
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of `edges` (a, b: long); component is the least vertex.

    Each round every vertex adopts its least neighbour, follows that pointer three times, and the edges
    are rewritten between the adopted vertices; edges inside a group vanish. Only minima are aggregated, so
    a vertex with very many edges costs partial sums, not a list, and the edge table shrinks each round.
    The rounds end when no edge is left. No edges: no rows.
    """
    edges = materialise(_ordered(edges), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(
            both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p")), "least"
        )
        up = least.select(F.col("v").alias("p"), F.col("p").alias("up"))
        parent = least
        for _ in range(2):
            parent = parent.join(up, "p").select("v", F.col("up").alias("p"))
        parent = materialise(parent, "parent")
        done = [least, edges]
        if labels is None:
            labels = parent
        else:
            step = parent.select(F.col("v").alias("p"), F.col("p").alias("up"))
            done.append(labels)
            labels = materialise(
                labels.join(step, "p", "left").select("v", F.coalesce("up", "p").alias("p")), "labels"
            )
        left = parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = materialise(
            _ordered(edges.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges"
        )
        discard(*done)
    if labels is None:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return labels.select(F.col("v").alias("vertex"), F.col("p").alias("component"))
