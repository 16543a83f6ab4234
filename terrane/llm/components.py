"""Connected components by alternating large-star and small-star, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import discard, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest node around it."""
    around = _both(edges)
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return around.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of an undirected edge list; component is the smallest node reachable.

    Loops, repeated edges and edges with a null end do not count; nodes without an edge are not returned.
    Every round is written to the shared folder, so a lost executor costs one round at most.
    """
    edges = edges.select(F.least(a, b).alias("b"), F.greatest(a, b).alias("a")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    now = materialize(edges.select("a", "b").distinct(), "edges")
    state = None
    while True:
        # one row: how many edges there are, and two sums over them
        r = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("t")).first()
        if (r["n"], r["s"], r["t"]) == state or not r["n"]:
            break
        state = (r["n"], r["s"], r["t"])
        then = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        now = then
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
