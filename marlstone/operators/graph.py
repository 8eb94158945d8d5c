"""Iterative graph operators: shortest paths, levels, components. Each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored


def shortest(edges: DataFrame, start: int) -> DataFrame:
    """``edges`` (u, v, cost) to (node, cost) of all nodes that ``start`` reaches. Costs below zero are an error; a round
    takes in what a step more makes cheaper, so that rounds end."""
    edges = stored(edges, "edges")
    if edges.where("cost < 0").limit(1).count():
        raise ValueError("costs below zero")
    known = stored(edges.sparkSession.createDataFrame([(start, 0)], "node int, best int"), "paths")
    fresh = known
    while True:
        found = fresh.select(F.col("node").alias("u"), "best").join(edges, "u").groupBy("v").agg(F.min(F.col("best") + F.col("cost")).alias("new"))
        better = found.join(known.select(F.col("node").alias("v"), F.col("best").alias("old")), "v", "left").where("old is null or new < old")
        fresh = stored(better.select(F.col("v").alias("node"), F.col("new").alias("best")), "paths")
        if not fresh.limit(1).count():
            return known.select("node", F.col("best").alias("cost"))
        known = stored(known.unionByName(fresh).groupBy("node").agg(F.min("best").alias("best")), "paths")


def mark(edges: DataFrame) -> tuple:
    """A fingerprint of distinct edges: their number, and two hashes of 64 bits over all."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), of any type that has an order, to (node, root): the least node that each can be reached from.
    Each round hangs every node's larger neighbours on its least neighbour, then every smaller one, until nothing moves:
    a number of rounds that grows with the logarithm of the nodes. Rows never outgrow the links, and a node with very
    many neighbours is summed where its rows are. The driver sees fingerprints only."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        edges = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "components")
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
