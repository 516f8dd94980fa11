"""Connected components over an edge table by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Labels every node of ``edges`` with the smallest node it reaches: columns ``node``, ``component``.

    Each round hooks every node to its smallest neighbour (never a larger node, so no cycles arise),
    jumps pointers until each tree is a star, and contracts the edges to the stars' roots. The edges left
    shrink by at least half a round; all state stays in tables of two ids a row. The hub of a star is a
    hot key only on the many side of a join with a table that holds it once.

    Edges with a null end and self loops join nothing (a self loop still names its node); repeated edges
    count once; no edges give an empty table.
    """
    spark = edges.sparkSession
    ids = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    current = cut(ids.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while True:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-parents")
        parents = _to_stars(parents)
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            labels = cut(labels.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "cc-labels")
        left = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = current.where("a <> b").join(left, "a").join(right, "b").where("ra <> rb")
        current = cut(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        if current.isEmpty():
            return labels.select("node", F.col("root").alias("component")) if labels is not None else spark.createDataFrame([], "node long, component long")


def _to_stars(parents: DataFrame) -> DataFrame:
    """Replaces every node's parent by its grandparent until none changes."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = cut(parents.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.coalesce(F.col("higher") < F.col("root"), F.lit(False)).alias("moved")), "cc-jump")
        parents = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parents
