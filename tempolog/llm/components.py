"""Connected components of a graph held as edge rows, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import settled


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node of an edge, with the least node as component.

    Two alternating steps shorten paths: each node hands its least neighbour to the larger neighbours, then to the
    smaller ones. Rounds grow with the logarithm of the longest path, and all of a round's work is joins and minima with
    map-side combining, so a node with very many edges costs no single task more than others (its rows are the split side
    of the join). Loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = settled(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = e.count()
    while size:
        both = e.union(e.select(F.col("b"), F.col("a")).toDF("a", "b"))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        before, e = e, settled(small.filter("a <> b").distinct())
        last, size = size, e.count()
        # as many edges, none of them new: nothing changed
        if size == last and e.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
