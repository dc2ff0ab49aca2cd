"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chatlake.llm.common import settled


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Large star: every node gives its larger neighbours the smallest node it knows.
    Small star: every node gives its smaller neighbours that node. The diameter of a
    component halves about every round; a node with many links is only ever the key
    of an aggregation or of a join that splits. Rounds end when nothing changes.
    """
    edges = settled(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = settled(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        lower = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = settled(lower.unionByName(least.withColumnRenamed("least", "b")).where("a <> b").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
