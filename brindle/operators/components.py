"""Connected components as alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import materialize


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every larger end occurs once and is nobody's smaller end."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    wrong = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return wrong.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Each round halves long paths, so rounds grow with the logarithm of a path's length. All
    steps are aggregations with partial sums or plain equi-joins, which AQE splits when one
    node has very many links; no component is ever gathered in one place. Null ends and loops
    are left out; no links give no rows; repeated links count once.
    """
    edges = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    edges = materialize(edges, "links")
    while not _is_star_forest(edges):
        edges = materialize(_small_star(_large_star(edges)), "stars", spent=[edges])
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
