"""Connected components of a graph given as edges, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelake.session import materialize


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("u") != F.col("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is hung under the vertex's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _distinct(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, are hung under its least neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return _distinct(
        joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    )


def _print(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``u`` and ``root``, its component's least vertex, for each vertex that is not a root itself.

    ``edges`` has columns ``u`` and ``v``. Alternates the star steps until nothing changes; each round is
    written to the shared folder. A vertex with very many edges is spread by partial aggregates and
    adaptive skew joins, it is never gathered.
    """
    edges = materialize(_distinct(edges.select("u", "v")), "edges")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = _print(edges)
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now
