"""Connected components of a distributed edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: Contraction needs a number of rounds in the logarithm of the longest path; this many would be a fault.
MOST_ROUNDS = 60


def turned(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select("a", "b").unionByName(back)


def star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours of each node to the smallest node among them and itself, one edge each.

    The smallest is found by an aggregate with map-side combining and joined back, so that a
    node with very many neighbours is an ordinary skewed join.
    """
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = pairs.join(least, "a")
    if larger_only:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.filter("m <> a").select("a", F.col("m").alias("b"))
        out = linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root the smallest node of its component.

    ``edges`` has columns a and b of one integer type; either order, repeats and loops may occur.
    Each round is written to the shared folder, and the one before is deleted.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    done = lambda: now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    if now.isEmpty():
        return done()
    sums = None
    for _ in range(MOST_ROUNDS):
        # The large star hangs larger neighbours on the least one; the small star hangs smaller ones.
        large = star(turned(now), larger_only=True)
        small = star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), larger_only=False)
        after = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        last, sums = sums, after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if sums == last:
            return done()
    raise RuntimeError("components did not settle")
