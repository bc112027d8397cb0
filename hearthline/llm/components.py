"""Connected components of a graph given as an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthline.llm.frames import merged, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): every node of ``edges`` (a, b) with the smallest node of its component.

    Each round points the larger neighbours of a node, and then the smaller ones, at its smallest neighbour. Rounds grow with the
    logarithm of a component's size; edges never multiply. A node with very many neighbours is only ever an aggregate's
    key, so its edges are combined before they are shuffled.
    """
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # Large star: the larger neighbours of every node go to the smallest of its neighbours and itself.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(merged(low), "a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        # Small star: a node's smaller neighbours and itself go to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(merged(low), "b").select(F.col("low"), F.explode(F.array("a", "b")).alias("node")).where("low <> node")
        e = stored(small.select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())
