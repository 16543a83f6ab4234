"""Scores of panels and their ranks.

A panel is a set of regions: panels(panel, ra_id). The other inputs are vars(ra_id, var_id), a row for each variable
of a region's description, inside(ra_id, sample_id) and members(ra_id, sample_id). A score is (panel, score).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.operators.metrics import EPSILON, purity, shared_counts, sizes


@dataclass
class Scene:
    """What scores are computed from; the number of samples in all counts too."""

    vars: DataFrame
    inside: DataFrame
    members: DataFrame
    n_samples: int

    @cached_property
    def purities(self) -> DataFrame:
        """(ra_id, n, purity); a row for each region, made once."""
        return purity(self.inside, self.members).persist()

    @cached_property
    def shares(self) -> DataFrame:
        """(a, b, j): Jaccard share of the pairs of regions that have common samples, made once."""
        n = sizes(self.inside)
        rows = shared_counts(self.inside).join(n.select(F.col("ra_id").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("ra_id").alias("b"), F.col("n").alias("n_b")), "b")
        return rows.select("a", "b", (F.col("n_shared") / (F.col("n_a") + F.col("n_b") - F.col("n_shared") + EPSILON)).alias("j")).persist()


def _counts(scene: Scene, panels: DataFrame) -> DataFrame:
    return panels.join(scene.vars, "ra_id").groupBy("panel", "var_id").agg(F.count(F.lit(1)).alias("n"))


def mean_variable_occurrence(scene: Scene, panels: DataFrame) -> DataFrame:
    """How often a variable of the panel occurs in it, on average."""
    return _counts(scene, panels).groupBy("panel").agg(F.avg("n").alias("score"))


def variable_occurs_in_all_regions(scene: Scene, panels: DataFrame, share: float = 0.9) -> DataFrame:
    """Variables that occur in nearly all regions, times the number of regions less one."""
    n = panels.groupBy("panel").agg(F.count(F.lit(1)).alias("regions"))
    hits = _counts(scene, panels).join(n, "panel").groupBy("panel", "regions").agg(F.sum(F.when(F.col("n") / F.col("regions") >= share, 1).otherwise(0)).alias("hits"))
    return hits.select("panel", (F.col("hits") * F.greatest(F.lit(0), F.col("regions") - 1)).cast("double").alias("score"))


def mean_purity(scene: Scene, panels: DataFrame) -> DataFrame:
    return panels.join(scene.purities, "ra_id", "left").groupBy("panel").agg(F.avg(F.coalesce("purity", F.lit(0.0))).alias("score"))


def sample_coverage(scene: Scene, panels: DataFrame) -> DataFrame:
    """Share of all samples that lie in a region of the panel."""
    covered = panels.join(scene.inside, "ra_id").select("panel", "sample_id").distinct().groupBy("panel").agg(F.count(F.lit(1)).alias("n"))
    return panels.select("panel").distinct().join(covered, "panel", "left").select("panel", (F.coalesce("n", F.lit(0)) / F.lit(float(max(1, scene.n_samples)))).alias("score"))


def num_base_vars(scene: Scene, panels: DataFrame) -> DataFrame:
    return panels.join(scene.vars, "ra_id").groupBy("panel").agg(F.countDistinct("var_id").cast("double").alias("score"))


def mean_overlap(scene: Scene, panels: DataFrame) -> DataFrame:
    """One less the mean Jaccard share of the panel's pairs; null for a single region."""
    both = panels.select("panel", F.col("ra_id").alias("a")).join(panels.select("panel", F.col("ra_id").alias("b")), "panel").where(F.col("a") < F.col("b")).join(scene.shares, ["a", "b"], "left")
    mean = both.groupBy("panel").agg(F.avg(F.coalesce("j", F.lit(0.0))).alias("j"))
    return panels.select("panel").distinct().join(mean, "panel", "left").select("panel", (1 - F.col("j")).alias("score"))


def num_regions_matches_perception(scene: Scene, panels: DataFrame, expected: float = 3.0) -> DataFrame:
    """Density of a normal distribution (deviation 2) at the number of regions."""
    z = (F.count(F.lit(1)) - expected) / 2
    return panels.groupBy("panel").agg((F.exp(-z * z / 2) / (2 * F.sqrt(2 * F.pi()))).alias("score"))


CONTRASTIVE = ((mean_overlap, 5.0), (mean_purity, 5.0), (num_regions_matches_perception, 1.0))
DESCRIPTIVE = ((variable_occurs_in_all_regions, 30.0), (mean_variable_occurrence, 10.0), (num_regions_matches_perception, 10.0), (mean_purity, 2.0), (sample_coverage, 10.0))


def rank_max(scores: DataFrame, value: str = "score", by: list[str] = ()) -> DataFrame:
    """Ascending ranks within ``by``; equals share the largest one."""
    order = W.partitionBy(*by).orderBy(value)
    return scores.withColumn("rank", F.rank().over(order) + F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1)


def ranked(scene: Scene, panels: DataFrame, funcs=CONTRASTIVE) -> DataFrame:
    """(panel, score): mean over the functions of the panel's rank times the function's weight."""
    every = None
    for i, (fn, weight) in enumerate(funcs):
        own = fn(scene, panels).select("panel", F.col("score"), F.lit(i).alias("fn"), F.lit(float(weight)).alias("weight"))
        every = own if every is None else every.unionByName(own)
    ranks = rank_max(every.withColumn("score", F.coalesce("score", F.lit(float("nan")))), "score", ["fn"])
    return ranks.groupBy("panel").agg((F.sum(F.col("rank") * F.col("weight")) / len(funcs)).alias("score"))


def top_panels(scores: DataFrame, k: int | None) -> DataFrame:
    """The k best panels; of equals the later one first."""
    out = scores.orderBy(F.desc("score"), F.desc("panel"))
    return out if k is None else out.limit(k)
