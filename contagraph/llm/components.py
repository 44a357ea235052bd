"""Connected components of an edge table, distributed: neighbours of a node all point at the smallest among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contagraph.llm.common import discard, stash


def _digest(edges: DataFrame) -> tuple:
    """What two tables of distinct edges share only if they are equal, but for a chance of 2**-64 or so."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b: long); a stashed table.

    Large-star and small-star steps alternate until nothing changes: each keeps components whole, and the number of
    rounds grows with the logarithm of the longest path. Nodes' minima combine before each shuffle and are written
    before they are joined, so that adaptive execution can split the centre of a large star. Loops, repeated edges and
    an empty table are fine; null ends are dropped.
    """
    now = stash(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    before = _digest(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stash(large.where(F.col("a") != F.col("b")).distinct(), "cc-large")
        low = stash(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = large.join(low, "a").select(F.col("b"), F.col("m"), F.col("a")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after_it = stash(small.where(F.col("a") != F.col("b")).distinct(), "cc-small")
        discard(now, least, large, low)
        now, after = after_it, _digest(after_it)
        if after == before:
            break
        before = after
    found = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    found = stash(found, "cc-labels")
    discard(now)
    return found
