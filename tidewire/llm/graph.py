"""Connected components as joins and minima, with a written table between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of an edge ``u, v``: root is the least node it reaches.

    Alternates two rewirings: every node hands its larger neighbours to its least neighbour, then
    its smaller ones. Minima are partial aggregates and the rewiring is a plain equi-join, so a
    node with very many neighbours is spread by Spark's skew join and is never gathered. Edges
    never grow in number; each round's are written to the shared folder and the ones before
    removed. Ends when a round changes nothing, which it does after a number of rounds that grows
    with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "edges")
        discard(large)
        after = _signature(edges)
        if after == before:
            break
        before = after
    leaves = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
