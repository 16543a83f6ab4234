"""Contrastive panels: one description of several regions that differ."""

from __future__ import annotations

from itertools import combinations

from terrane.operators.graph import small_components
from terrane.operators.metrics import EPSILON
from terrane.operators.scores import CONTRASTIVE, ranked, top_panels
from terrane.plans.annotate import Annotation, Space, by_variables, merge_annotations
from terrane.sources.tables import small_table


def merge_contrastive(space: Space, annotations: list[Annotation], threshold: float = 0.95) -> list[list[Annotation]]:
    """Panels by variables, after merging variables whose regions match one to one.

    Two groups of as many regions match if the pairs of regions with a Jaccard share above the threshold leave as
    many components as a group has regions, each of both groups' variables.
    """
    flat = sorted(annotations, key=lambda a: a.order)
    place = {a: i for i, a in enumerate(flat)}
    n, shared = space.pair_shares(flat)
    alike = {p for p, c in shared.items() if c / (n[p[0]] + n[p[1]] - c + EPSILON) > threshold}
    near: dict[int, set] = {i: set() for i in range(len(flat))}
    groups = by_variables(flat)
    for one, two in combinations(sorted(groups), 2):
        a, b = groups[one], groups[two]
        if len(a) != len(b):
            continue
        nodes = sorted(place[x] for x in a + b)
        edges = {i: {j for j in nodes if (min(i, j), max(i, j)) in alike} for i in nodes}
        parts = small_components(edges)
        if len(parts) == len(a) and all(len({flat[i].variables for i in p}) == 2 for p in parts):
            for i in nodes:
                near[i] |= edges[i]
    merged = [merge_annotations([flat[i] for i in sorted(p)]) for p in small_components(near)]
    panels = by_variables(sorted(merged, key=lambda a: a.order))
    return [panels[k] for k in sorted(panels)]


def contrastive(space: Space, annotations: list[Annotation], max_panels: int | None = 4, merge_threshold: float = 0.95, filter_layouts: bool = True, ranking_funcs=CONTRASTIVE) -> list[list[Annotation]]:
    """The best panels, best first; none if there is no candidate."""
    candidates = merge_contrastive(space, annotations, merge_threshold)
    if filter_layouts:
        candidates = [p for p in candidates if len(p) > 1]
    return [candidates[i] for i, _ in panel_scores(space, candidates, ranking_funcs, max_panels)]


def panel_scores(space: Space, candidates: list[list[Annotation]], ranking_funcs=CONTRASTIVE, max_panels: int | None = None) -> list[tuple[int, float]]:
    """(place in the list, score), best first. A single candidate has the score -1."""
    if not candidates:
        return []
    flat = sorted({a for p in candidates for a in p}, key=lambda a: a.order)
    place = {a: i for i, a in enumerate(flat)}
    listed = small_table(space.spark, [(i, place[a]) for i, p in enumerate(candidates) for a in p], "panel int, ra_id int")
    rows = top_panels(ranked(space.scene(flat), listed, ranking_funcs), max_panels).collect()  # a row for each panel
    return [(r["panel"], -1.0 if len(candidates) == 1 else r["score"]) for r in rows]
