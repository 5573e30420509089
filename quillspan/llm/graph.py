"""Connected components of an edge table, without collecting links or components anywhere.

Large-star and small-star steps alternate until the edges are stars around the smallest node of
each component. Every step is two key shuffles with map-side minima, so a node with very many
neighbours costs no more than its rows; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import drop, written


def _minima(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    low = _minima(down)
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), a long each; the root is the component's smallest node.

    Loops and repeated edges do no harm; no edges give no rows.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if state == before or state["n"] == 0:
            break
        before, last = state, now
        now = written(_small(_large(now)), "edges")
        drop(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
