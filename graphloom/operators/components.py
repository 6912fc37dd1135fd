"""Connected components by contraction to stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import discard, materialize, scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("x")).first()
    return r["n"], r["x"] or 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), component being the smallest node that can be reached.

    Each round hangs a node's larger neighbours on its smallest one, then its smaller ones too; rounds grow with
    the logarithm of the graph's size and each ends in a written table. Sums by node are partial before they are
    dealt out, so that a node with very many links is no task's alone.
    """
    with scratch(links.sparkSession) as scope:
        edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = materialize(edges, "links")
        state = _state(edges)
        while state[0]:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            down = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
            new = materialize(small.where("a <> b").distinct(), "links")
            discard(edges)
            edges, now = new, _state(new)
            if now == state:
                break
            state = now
        scope.keep(edges)
    found = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(roots)
