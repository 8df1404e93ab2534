"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sum of hashes: equal for equal edge sets."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v and m, the least v of each u: aggregated, written, and joined back, so that a node with many edges is split."""
    return edges.join(written(edges.groupBy("u").agg(F.min("v").alias("m")), "least"), "u")


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> node, root: the least node that each node of a link reaches.

    Each round replaces edges by edges to local minima and is written to the shared folder; the number of rounds grows
    with the logarithm of the number of nodes. Neighbours are never collected. No links: no rows.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(edges)
    while seen[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        starred = _with_least(written(large, "edges"))
        small = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(starred.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    # Converged: every edge leads from a node to its root.
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
