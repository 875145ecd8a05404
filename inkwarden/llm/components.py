"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    """(k, m): each a and its least b. The key is an aggregate too: dealt out anew for a join, so that its partitions can be split."""
    return edges.groupBy("a").agg(F.max("a").alias("k"), F.min("b").alias("m")).drop("a")


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on the least node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("k", F.least("k", "m").alias("m"))
    return both.join(least.hint("merge"), F.col("a") == F.col("k")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hang on the least of these (a > b in every edge)."""
    joined = edges.join(_least(edges).hint("merge"), F.col("a") == F.col("k"))
    return joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge to another; root is the least node reachable.

    Null ends and edges of a node to itself are left out; direction and repeats don't matter;
    no edges give no rows. Each round is written to the checkpoint folder, and only two
    numbers come back to the driver; rounds grow with the logarithm of the longest path.
    All joins merge: a broadcast in each round, below Spark's threshold or not, fills the driver.
    A hub's edges are joined, never gathered, so adaptive execution can split them.
    """
    edges = edges.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b")).where("a > b")
    edges = cut(edges.distinct())
    before = None
    while True:
        edges = cut(_small(_large(edges)))
        count, digest = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (count, digest) == before or not count:
            break
        before = (count, digest)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
