"""Connected components by alternating stars, as Spark joins and sums over saved edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import saved, work_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component, for every node of an edge (u, v).

    Large-star hangs a node's larger neighbours on its smallest neighbour, small-star its smaller
    ones; edges stay as many as nodes at most, and chains halve, so few rounds suffice. A node with
    very many neighbours is a sum before the shuffle and the large side of a join that Spark splits.
    """
    spark = edges.sparkSession
    folder = work_dir(spark, "stars")
    now = saved(canonical(edges), f"{folder}/0")
    state, turn = signature(now), 0
    while True:
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = canonical(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
        large = saved(large, f"{folder}/{turn}-large")
        # here u > v: u's smaller neighbours and u itself hang on the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = canonical(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
        now = saved(small, f"{folder}/{turn}")
        before, state = state, signature(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node, without loops."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
