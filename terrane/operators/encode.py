"""Variables as indicators: k-means bins of numbers, one indicator for each level of the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.rules import RULE, interval, values
from terrane.sources.ingest import CONTINUOUS, DISCRETE, Ingested, number
from terrane.sources.tables import small_table

#: An indicator's id is its variable's number times this, plus its place among the variable's indicators.
IND = 1 << 32
#: Up to so many distinct values of a variable its bins are found in one task, beyond by distributed passes.
ONE_TASK = 200_000
MAX_ROUNDS = 300


def informative_columns(df: DataFrame, id_col: str) -> list[str]:
    """The columns with more than one value, missing ones aside; one pass, and no distinct counts."""
    columns = [c for c in df.columns if c != id_col]
    numeric = {n for n, t in df.dtypes if t not in ("string",)}
    value = {c: number(F.col(f"`{c}`")) if c in numeric else F.col(f"`{c}`") for c in columns}
    row = df.agg(*[(F.min(value[c]) < F.max(value[c])).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def constant_filter(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col, *[f"`{c}`" for c in informative_columns(df, id_col)])


def kmeans_edges(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Inner edges of k bins of sorted distinct values: Lloyd from even centres; a centre without points moves
    to the point that is worst served; edges are half-way between centres."""
    k = min(k, len(points))
    if k < 2:
        return np.zeros(0)
    tolerance = 1e-4 * np.average((points - np.average(points, weights=weights)) ** 2, weights=weights)

    def measure(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = np.searchsorted(edges, points, side="right")
        return np.bincount(new, minlength=k), np.bincount(new, weights, k), np.bincount(new, weights * points, k)

    def worst(edges: np.ndarray, centres: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
        new = np.searchsorted(edges, points, side="right")
        far = np.where(sizes[new] > 1, np.abs(points - centres[new]), -1)
        return points[np.argsort(-far, kind="stable")[:n]]

    return _lloyd(points[0], points[-1], k, tolerance, measure, worst)


def _lloyd(lo: float, hi: float, k: int, tolerance: float, measure: Callable, worst: Callable) -> np.ndarray:
    """Edges from ``measure(edges)``: distinct points, mass and weighted sum of every bin, and ``worst(edges, centres,
    sizes, n)``: the n worst served points, of equals the smallest, those that are alone in their bin last."""
    centres = lo + (hi - lo) * (np.arange(k) + 0.5) / k
    before = None  # bins are stretches of the sorted points: with equal sizes they are equal
    for _ in range(MAX_ROUNDS):
        for _ in range(k + 1):
            centres.sort()
            edges = (centres[1:] + centres[:-1]) / 2
            sizes, mass, total = measure(edges)
            empty = np.flatnonzero(sizes == 0)
            if not len(empty):
                break
            for e, p in zip(empty, worst(edges, centres.copy(), sizes, len(empty))):
                centres[e] = p
        moved = np.where(mass > 0, total / np.where(mass > 0, mass, 1), centres)
        shift = float(((moved - centres) ** 2).sum())
        centres = moved
        if before is not None and np.array_equal(sizes, before) or shift <= tolerance:
            break
        before = sizes
    centres.sort()
    edges = (centres[1:] + centres[:-1]) / 2
    return edges[np.concatenate(([True], np.diff(edges) > 1e-8))]


def _distributed_edges(points: DataFrame, k: int) -> list[float]:
    """The same bins by passes over (value, n) that aggregate on every executor."""
    value, n = F.col("value"), F.col("n")
    lo, hi, mean, distinct = points.agg(F.min(value), F.max(value), F.sum(value * n) / F.sum(n), F.count(F.lit(1))).first()
    k = min(k, distinct)
    if k < 2:
        return []
    tolerance = 1e-4 * points.agg(F.sum((value - mean) ** 2 * n) / F.sum(n)).first()[0]

    def bin_of(edges: np.ndarray):
        return sum((F.when(value >= e, 1).otherwise(0) for e in edges.tolist()), F.lit(0))

    def measure(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.zeros((3, k))
        for r in points.groupBy(bin_of(edges).alias("bin")).agg(F.count(F.lit(1)).alias("size"), F.sum(n).alias("mass"), F.sum(value * n).alias("total")).collect():  # k rows
            out[:, r["bin"]] = r["size"], r["mass"], r["total"]
        return out[0].astype(int), out[1], out[2]

    def worst(edges: np.ndarray, centres: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
        of = bin_of(edges) + 1
        centre = F.element_at(F.array(*map(F.lit, centres.tolist())), of)
        alone = F.element_at(F.array(*map(F.lit, (sizes < 2).tolist())), of)
        rows = points.select(value, F.when(alone, -1.0).otherwise(F.abs(value - centre)).alias("far"))
        return np.array([r["value"] for r in rows.orderBy(F.desc("far"), "value").limit(count).collect()])  # k rows at most

    return _lloyd(lo, hi, k, tolerance, measure, worst).tolist()


def bin_edges(numbers: DataFrame, n_bins: int = 5) -> dict[int, list[float]]:
    """Inner bin edges of every variable in (sample_id, var_id, value); none for a constant one."""
    points = numbers.where(F.col("value").isNotNull()).groupBy("var_id", "value").agg(F.count(F.lit(1)).alias("n")).persist()
    sizes = {r["var_id"]: r["count"] for r in points.groupBy("var_id").count().collect()}  # a row for each variable
    small = [v for v, n in sizes.items() if n <= ONE_TASK]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        edges = kmeans_edges(pdf["value"].to_numpy(float), pdf["n"].to_numpy(float), n_bins)
        return pd.DataFrame({"var_id": [pdf["var_id"].iloc[0]], "edges": [edges.tolist()]})

    out = {v: [] for v in sizes}
    if small:
        found = points.where(F.col("var_id").isin(small)).groupBy("var_id").applyInPandas(fit, "var_id int, edges array<double>")
        out |= {r["var_id"]: list(r["edges"]) for r in found.collect()}  # n_bins - 1 numbers for each variable
    for v in set(sizes) - set(small):
        out[v] = _distributed_edges(points.where(F.col("var_id") == v), n_bins)
    points.unpersist()
    return out


@dataclass
class Indicators:
    """indicators(ind_id, var_id, var, ord, rule) and membership(ind_id, sample_id): a row for each sample it holds."""

    indicators: DataFrame
    membership: DataFrame


def _ind(var_id, ord_):
    return var_id.cast("long") * IND + ord_.cast("long")


def discretize(numbers: DataFrame, names: DataFrame, edges: dict[int, list[float]]) -> Indicators:
    """Bins of (sample_id, var_id, value); a value on an edge is in the upper bin, missing values in none. A
    variable without edges has the one indicator that its value equals the constant."""
    spark = numbers.sparkSession
    rows = []
    for v, e in edges.items():
        bounds = [float("-inf"), *e, float("inf")]
        rows += [(v, i, bounds[i], bounds[i + 1]) for i in range(len(e) + 1)] if e else []
    binned = [v for v, e in edges.items() if e]
    table = small_table(spark, rows, "var_id int, ord int, lower double, upper double")
    spread = small_table(spark, [(v, edges[v]) for v in binned], "var_id int, edges array<double>")
    own = numbers.where(F.col("value").isNotNull())
    placed = own.join(F.broadcast(spread), "var_id").select("sample_id", "var_id", F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("ord"))  # a row of edges for each column of the input
    bins = table.join(names.select("var_id", "name"), "var_id").select(_ind(F.col("var_id"), F.col("ord")).alias("ind_id"), "var_id", F.col("name").alias("var"), "ord", interval(F.col("lower"), F.col("upper"), F.col("name")).alias("rule"))
    constant = own.where(~F.col("var_id").isin(binned)) if binned else own
    same = constant.groupBy("var_id").agg(F.first("value").alias("value")).join(names.select("var_id", "name"), "var_id")
    same = same.select(_ind(F.col("var_id"), F.lit(0)).alias("ind_id"), "var_id", F.col("name").alias("var"), F.lit(0).alias("ord"), values(F.array(F.col("value").cast("string")), F.col("name")).alias("rule"))
    membership = placed.unionByName(constant.select("sample_id", "var_id", F.lit(0).alias("ord"))).select(_ind(F.col("var_id"), F.col("ord")).alias("ind_id"), "sample_id")
    return Indicators(bins.unionByName(same), membership)


def one_hot(levels: DataFrame, variables: DataFrame) -> Indicators:
    """One indicator for every declared level of (sample_id, var_id, level, code)."""
    declared = variables.where((F.col("kind") == DISCRETE) & F.col("categories").isNotNull()).select("var_id", "name", F.posexplode("categories").alias("ord", "level"))
    inds = declared.select(_ind(F.col("var_id"), F.col("ord")).alias("ind_id"), "var_id", F.col("name").alias("var"), "ord", values(F.array("level"), F.col("name")).alias("rule"))
    return Indicators(inds, levels.select(_ind(F.col("var_id"), F.col("code")).alias("ind_id"), "sample_id"))


def expand(data: Ingested, n_bins: int = 5, edges: dict[int, list[float]] | None = None) -> Indicators:
    """Indicators of all variables; those that hold no sample are left out."""
    edges = bin_edges(data.numbers, n_bins) if edges is None else edges
    a = discretize(data.numbers, data.variables.where(F.col("kind") == CONTINUOUS), edges)
    b = one_hot(data.levels, data.variables)
    membership = a.membership.unionByName(b.membership)
    used = membership.select("ind_id").distinct()
    return Indicators(a.indicators.unionByName(b.indicators).join(used, "ind_id", "left_semi"), membership)


__all__ = ["Indicators", "RULE", "bin_edges", "constant_filter", "discretize", "expand", "informative_columns", "kmeans_edges", "one_hot"]
