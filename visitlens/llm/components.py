"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import drop_saved, saved

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: bigint); the root is the smallest node reachable.

    Alternates the two star steps: each node's larger neighbours, then its smaller ones, are hung on its
    smallest neighbour, until every tree is a star. Each round is a few shuffles of the links that are left,
    written to the shared folder in place of the round before; the smallest neighbour is a plain aggregate, so a node with many links
    never has to fit into a task.
    """
    downwards = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = saved(downwards.where("a > b").distinct(), "links")
    before = _checksum(edges)
    for _ in range(MOST_ROUNDS):
        last, edges = edges, saved(_small_star(_large_star(edges)), "links")
        drop_saved(last)
        now = _checksum(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return leaves.unionByName(roots)


def _checksum(edges: DataFrame) -> tuple:
    """Equal for equal sets of links: their number, two xors and a sum of hashes."""
    one, two = F.xxhash64("a", "b"), F.xxhash64("b", "a")
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(one), F.bit_xor(two), F.sum(one.cast("decimal(38,0)"))).first()
    )


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node itself)."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; links point downwards here."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
