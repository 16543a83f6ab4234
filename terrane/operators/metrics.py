"""Metrics of regions and of pairs of regions, from (ra_id, sample_id) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value in the denominator of the Jaccard share.
EPSILON = 1e-8


def sizes(inside: DataFrame) -> DataFrame:
    return inside.groupBy("ra_id").agg(F.count(F.lit(1)).alias("n"))


def purity(inside: DataFrame, members: DataFrame) -> DataFrame:
    """(ra_id, n, purity): the share of a region's samples that its rule holds."""
    both = inside.join(members.withColumn("hit", F.lit(1.0)), ["ra_id", "sample_id"], "left")
    return both.groupBy("ra_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("purity"))


def shared_counts(inside: DataFrame, same: str | None = None) -> DataFrame:
    """(a, b, n_shared) with a < b, of pairs that share a sample: one self-join on the sample. ``same`` names a
    column that both must agree on. A sample is in few regions, so the join grows with the samples."""
    keys = ["sample_id"] + ([same] if same else [])
    left = inside.select(*keys, F.col("ra_id").alias("a"))
    right = inside.select(*keys, F.col("ra_id").alias("b"))
    return left.join(right, keys).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def pairs(inside: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, n_shared) of all pairs with a < b, without common samples too; regions are few."""
    n = sizes(inside)
    every = n.select(F.col("ra_id").alias("a"), F.col("n").alias("n_a")).crossJoin(n.select(F.col("ra_id").alias("b"), F.col("n").alias("n_b"))).where(F.col("a") < F.col("b"))
    return every.join(shared_counts(inside), ["a", "b"], "left").select("a", "b", "n_a", "n_b", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))


def _share(of: Callable[..., Column]) -> Callable[[], Column]:
    share = F.when(of("n_a", "n_b") > 0, F.col("n_shared") / of("n_a", "n_b")).otherwise(0.0)
    return lambda: F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), 0.0).otherwise(share)


def max_shared_pct() -> Column:
    """Common samples over those of the smaller region."""
    return _share(F.least)()


def min_shared_pct() -> Column:
    """Common samples over those of the larger region."""
    return _share(F.greatest)()


def jaccard() -> Column:
    return F.col("n_shared") / (F.col("n_a") + F.col("n_b") - F.col("n_shared") + EPSILON)


METRICS = {"max_shared_sample_pct": max_shared_pct, "min_shared_sample_pct": min_shared_pct, "shared_sample_pct": jaccard}


def condensed(inside: DataFrame, metric: Callable[[], Column] = jaccard) -> DataFrame:
    """(a, b, value) of every pair, in order: the upper triangle of the matrix of a metric over the pair's columns."""
    return pairs(inside).select("a", "b", metric().alias("value"))
