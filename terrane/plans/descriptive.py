"""Descriptive panels: regions that do not overlap, described by all variables that fit."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import replace

from pyspark.sql import functions as F

from terrane.operators.graph import greedy_coloring, independent_sets, max_cliques, small_components
from terrane.operators.metrics import pairs, purity
from terrane.operators.metrics import min_shared_pct as default_metric
from terrane.operators.scores import DESCRIPTIVE, ranked
from terrane.plans.annotate import Annotation, Space, merge_annotations, merge_clauses
from terrane.sources.tables import small_table

#: Fixed bound: with fewer regions all ways to choose panels are looked at, else a colouring stands in.
EXACT_BELOW = 20


def filter_annotations(space: Space, annotations: list[Annotation], min_samples: int = 5, min_purity: float = 0.5) -> list[Annotation]:
    """Those with at least so many samples and so pure a region."""
    if not annotations:
        return []
    rows = purity(space.inside(annotations), space.members(annotations)).where((F.col("n") >= min_samples) & (F.col("purity") >= min_purity)).collect()
    kept = {r["ra_id"] for r in rows}
    return [a for i, a in enumerate(annotations) if i in kept]


def descriptive_merge(space: Space, annotations: list[Annotation], metric=default_metric, metric_is_distance: bool = False, threshold: float = 0.9, method: str = "connected-components") -> list[Annotation]:
    """Merge annotations whose metric is above the threshold (below it, for a distance); cliques may overlap."""
    if method not in ("connected-components", "max-cliques"):
        raise ValueError("method must be connected-components or max-cliques")
    if not annotations:
        return []
    near: dict[int, set] = {i: set() for i in range(len(annotations))}
    value = metric()
    linked = value < threshold if metric_is_distance else value > threshold
    for r in pairs(space.inside(annotations)).where(linked).select("a", "b").collect():  # pairs of regions
        near[r["a"]].add(r["b"])
        near[r["b"]].add(r["a"])
    groups = small_components(near) if method == "connected-components" else max_cliques(near)
    return [merge_annotations([annotations[i] for i in sorted(g)]) for g in groups]


def generate_layout(space: Space, annotations: list[Annotation], max_panels: int | None = None, max_overlap: float = 0.0, ranking_funcs=DESCRIPTIVE, allow_greedy_approx: bool = True) -> list[list[Annotation]]:
    """Panel after panel the best set of regions that share no more than ``max_overlap`` of the smaller one; the pair
    counts are made once, and what is placed leaves them."""
    flat = list(annotations)
    n, shared = space.pair_shares(flat)
    scene = space.scene(flat) if flat else None
    left, layout = list(range(len(flat))), []
    while left and (max_panels is None or len(layout) < max_panels):
        now = set(left)
        near: dict[int, set] = {i: set() for i in left}
        for (i, j), c in shared.items():
            if i in now and j in now and c / max(1, min(n.get(i, 0), n.get(j, 0))) > max_overlap:
                near[i].add(j)
                near[j].add(i)
        if len(near) < EXACT_BELOW or not allow_greedy_approx:
            sets = [sorted(s) for s in independent_sets(near)]
        else:
            colors = defaultdict(list)
            for i, c in greedy_coloring(near, "largest_first").items():
                colors[c].append(i)
            sets = [sorted(s) for _, s in sorted(colors.items())]
        if len(sets) > 1:
            listed = small_table(space.spark, [(k, i) for k, s in enumerate(sets) for i in s], "panel int, ra_id int")
            best = ranked(scene, listed, ranking_funcs).orderBy(F.desc("score"), "panel").first()["panel"]
        else:
            best = 0
        layout.append([flat[i] for i in sets[best]])
        left = [i for i in left if i not in set(sets[best])]
    return layout


def enrich(space: Space, layout: list[list[Annotation]], background: list[Annotation], threshold: float = 0.9) -> list[list[Annotation]]:
    """Add the descriptions of background regions that cover more than ``threshold`` of a region and whose variable it
    does not have; the region stays."""
    flat = [a for panel in layout for a in panel]
    if not flat or not background:
        return layout
    n, shared = space.pair_shares(flat + background)
    out = []
    for i, a in enumerate(flat):
        more = [b for j, b in enumerate(background, len(flat)) if b.base_variable not in a.variables and n.get(i) and shared.get((i, j), 0) / n[i] > threshold]
        out.append(replace(a, clauses=merge_clauses([c for x in [a, *more] for c in x.clauses])) if more else a)
    again = iter(out)
    return [[next(again) for _ in panel] for panel in layout]


def descriptive(space: Space, annotations: list[Annotation], max_panels: int | None = 4, merge_metric=default_metric, metric_is_distance: bool = False, merge_method: str = "connected-components", merge_threshold: float = 0.8, cluster_min_samples: int = 5, cluster_min_purity: float = 0.5, max_overlap: float = 0.0, enrich_with_background: bool = True, background_enrichment_threshold: float = 0.9, ranking_funcs=DESCRIPTIVE, allow_greedy_approx: bool = True) -> list[list[Annotation]]:
    """Split, filter, merge, lay out and enrich."""
    parts = [p for a in annotations for p in space.split(a)]
    parts = filter_annotations(space, parts, cluster_min_samples, cluster_min_purity)
    merged = descriptive_merge(space, parts, merge_metric, metric_is_distance, merge_threshold, merge_method)
    layout = generate_layout(space, merged, max_panels, max_overlap, ranking_funcs, allow_greedy_approx)
    return enrich(space, layout, annotations, background_enrichment_threshold) if enrich_with_background else layout
