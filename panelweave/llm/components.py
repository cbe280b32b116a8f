"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum with partial aggregation and a join back, so a node with very
many edges is neither collected nor windowed. Each round is written to the shared folder,
which cuts the lineage; rounds end when a round changes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelweave.session import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u < v). Large: link larger neighbours to the least of the neighbourhood; small: the others and oneself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = both.filter("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    return linked.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component. ``edges`` has two comparable columns u and v.

    Nodes without an edge to another node are not listed. NULL ends are left out. An empty table gives no rows.
    """
    edges = stage(
        edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0 or mark == seen:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
                edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            )
        seen = mark
        edges = stage(_star(_star(edges, True), False), "edges")
