"""Connected components of a link table, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.frames import dropped, written


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links(a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every node's larger neighbours,
    then its smaller ones, are tied to the smallest node near it. Each step is
    a minimum per node, combined before the shuffle, and a join whose sides are
    read from tables, so a node with very many links is split.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = _print_of(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct())
        for table in (near, large, low, edges):
            dropped(table)
        edges, before, seen = after, seen, _print_of(after)
        if seen == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
