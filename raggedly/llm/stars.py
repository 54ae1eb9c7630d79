"""Connected components by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for every id that ``links`` (``u, v``) name.

    A large star moves the larger neighbours of each node to the smallest node around it, a
    small star moves the smaller ones. A node's smallest neighbour is a minimum, combined
    before the shuffle; the neighbours themselves stay spread, so a node with very many is
    no task's burden. Each round is written to the shared folder; the driver only learns
    whether all are stars. Links may repeat, have either direction, or join an id to itself.
    """
    links = stored(links.select("u", "v"), "given-links")  # costly to find, and read twice
    own = links.where(F.col("u") == F.col("v")).select("u").distinct()
    edges = stored(
        links.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    while not _are_stars(edges):
        edges = stored(_small_star(_large_star(edges)), "stars")
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id")).union(own).distinct()
    return found.union(
        roots.join(edges, F.col("id") == F.col("u"), "left_anti").select(
            "id", F.col("id").alias("component")
        )
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id has one link to a smaller one at most, and that one has none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """(larger neighbour, smallest of the node and its neighbours)."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, F.col("u") == F.col("n"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """The same among a node's smaller neighbours and the node itself."""
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    moved = (
        edges.join(least, F.col("u") == F.col("n"))
        .where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.union(least.select("n", "m")).distinct()
