"""Region annotations: descriptions of regions of an embedding, and how they merge and split.

Every region is a union of pieces, the connected parts of the indicators' own regions. Where samples lie is
worked out once, for the pieces; annotations are small objects that list pieces and clauses, and merging and
splitting them moves no samples.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.rules import Equals, IncompatibleIndicators, Interval, OneOf, merge_rules
from terrane.operators.embedding import Grid, binned, embedding_scale
from terrane.operators.encode import Indicators, constant_filter, expand
from terrane.operators.graph import small_components
from terrane.operators.metrics import shared_counts, sizes
from terrane.operators.regions import inside_triangles, region_cells, samples_inside, triangulated
from terrane.operators.scores import Scene
from terrane.sources.ingest import ingest, sample_exact
from terrane.sources.shared import settled
from terrane.sources.tables import small_table


@dataclass(frozen=True)
class Clause:
    """Samples of any of these indicators of one variable."""

    var_id: int
    rule: object
    inds: frozenset

    @property
    def order(self):
        return (self.var_id, self.rule.lower) if isinstance(self.rule, Interval) else (self.var_id, min(map(str, self.rule.values)))


def merge_clauses(clauses) -> tuple[Clause, ...]:
    """By variable: rules that can be merged in turn are; the others stand side by side."""
    by_var = defaultdict(list)
    for c in clauses:
        by_var[c.var_id].append(c)
    out = []
    for var_id, own in sorted(by_var.items()):
        for rule in merge_rules([c.rule for c in own]):
            out.append(Clause(var_id, rule, frozenset().union(*[c.inds for c in own if rule == c.rule or rule.contains(c.rule)])))
    return tuple(sorted(out, key=lambda c: c.order))


@dataclass(frozen=True)
class Annotation:
    """Clauses that all must hold, the pieces of the region, and what it was made from."""

    clauses: tuple[Clause, ...]
    pieces: frozenset
    sources: tuple = field(default=(), compare=False)

    @property
    def variables(self) -> tuple[int, ...]:
        return tuple(c.var_id for c in self.clauses)

    @property
    def base_variable(self) -> int:
        if len(self.clauses) != 1:
            raise TypeError("a description of several clauses has no base variable")
        return self.clauses[0].var_id

    @property
    def name(self) -> str:
        return "\n".join(str(c.rule) for c in self.clauses)

    @property
    def order(self):
        return (tuple(c.order for c in self.clauses), tuple(sorted(self.pieces)))

    def can_merge_with(self, other: Annotation) -> bool:
        if len(self.clauses) == len(other.clauses) == 1 and self.base_variable == other.base_variable:
            return self.clauses[0].rule.can_merge_with(other.clauses[0].rule)
        return True

    def leaves(self) -> list[Annotation]:
        """What the annotation was made from in the end."""
        if not self.sources:
            return [self]
        return sorted({leaf for s in self.sources for leaf in s.leaves()}, key=lambda a: a.order)


def merge_annotations(annotations: list[Annotation]) -> Annotation:
    """Descriptions merged, regions united; one alone is returned as it is."""
    if len(annotations) == 1:
        return annotations[0]
    clauses = merge_clauses([c for a in annotations for c in a.clauses])
    return Annotation(clauses, frozenset().union(*[a.pieces for a in annotations]), tuple(annotations))


def merge_indicators(a: Annotation, b: Annotation) -> Annotation:
    if not a.can_merge_with(b):
        raise IncompatibleIndicators("rules of one variable that do not meet")
    return merge_annotations([a, b])


def by_variables(annotations: list[Annotation]) -> dict[tuple, list[Annotation]]:
    out = defaultdict(list)
    for a in annotations:
        out[a.variables].append(a)
    return dict(out)


def by_base_variable(annotations: list[Annotation]) -> dict[int, list[Annotation]]:
    out = defaultdict(list)
    for a in sorted(annotations, key=lambda a: a.order):
        out[a.base_variable].append(a)
    return dict(out)


class Space:
    """Samples, indicators and pieces that annotations refer to."""

    def __init__(self, samples: DataFrame, indicators: Indicators, scale: float, grid: Grid, pieces: DataFrame, corners: DataFrame | None):
        self.samples, self.indicators, self.scale, self.grid = samples, indicators, scale, grid
        self.pieces = settled(pieces.select("ind_id", "part_id", "sample_id").distinct())
        self.n_samples = samples.count()
        self._corners = corners
        self._touching: dict | None = None

    @property
    def spark(self):
        return self.samples.sparkSession

    def _listed(self, rows: list[tuple], schema: str) -> DataFrame:
        return small_table(self.spark, rows, schema)

    def inside(self, annotations: list[Annotation]) -> DataFrame:
        """(ra_id, sample_id) with the place in the list as ra_id."""
        rows = [(i, int(ind), int(part)) for i, a in enumerate(annotations) for ind, part in sorted(a.pieces)]
        listed = self._listed(rows, "ra_id int, ind_id long, part_id int")
        return self.pieces.join(listed, ["ind_id", "part_id"]).select("ra_id", "sample_id").distinct()

    def members(self, annotations: list[Annotation]) -> DataFrame:
        """(ra_id, sample_id) of the samples for which all clauses hold."""
        rows = [(i, k, len(a.clauses), int(ind)) for i, a in enumerate(annotations) for k, c in enumerate(a.clauses) for ind in sorted(c.inds)]
        listed = self._listed(rows, "ra_id int, clause int, clauses int, ind_id long")
        hit = self.indicators.membership.join(listed, "ind_id").select("ra_id", "clause", "clauses", "sample_id").distinct()
        return hit.groupBy("ra_id", "clauses", "sample_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("clauses")).select("ra_id", "sample_id")

    def vars(self, annotations: list[Annotation]) -> DataFrame:
        return self._listed([(i, v) for i, a in enumerate(annotations) for v in a.variables], "ra_id int, var_id int")

    def scene(self, annotations: list[Annotation]) -> Scene:
        return Scene(self.vars(annotations), self.inside(annotations).persist(), self.members(annotations).persist(), self.n_samples)

    def pair_shares(self, annotations: list[Annotation], same_variable: bool = False) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
        """Sizes, and common samples of pairs that have any; a row for each pair of regions comes to the driver."""
        if not annotations:
            return {}, {}
        inside = self.inside(annotations)
        same = None
        if same_variable:
            inside, same = inside.join(self.vars(annotations), "ra_id"), "var_id"
        inside = inside.persist()
        own = sizes(inside).select(F.col("ra_id").alias("a"), F.col("ra_id").alias("b"), F.col("n").alias("n_shared"))
        rows = own.unionByName(shared_counts(inside, same)).collect()
        inside.unpersist()
        return {r["a"]: r["n_shared"] for r in rows if r["a"] == r["b"]}, {(r["a"], r["b"]): r["n_shared"] for r in rows if r["a"] != r["b"]}

    def touching(self) -> dict[tuple, set]:
        """For every piece the pieces that it overlaps: they share a sample or a grid point."""
        if self._touching is None:
            where = self.pieces.select("ind_id", "part_id", F.col("sample_id").cast("string").alias("at"))
            if self._corners is not None:
                where = where.unionByName(self._corners)
            both = where.join(where.select(F.col("ind_id").alias("i2"), F.col("part_id").alias("p2"), "at"), "at")
            both = both.where(F.struct("ind_id", "part_id") < F.struct("i2", "p2")).select("ind_id", "part_id", "i2", "p2").distinct()
            self._touching = defaultdict(set)
            for r in both.collect():  # pairs of pieces
                self._touching[(r[0], r[1])].add((r[2], r[3]))
                self._touching[(r[2], r[3])].add((r[0], r[1]))
        return self._touching

    def split(self, annotation: Annotation) -> list[Annotation]:
        """One annotation for every connected part."""
        if len(annotation.pieces) == 1:
            groups = [sorted(annotation.pieces)]
        else:
            near = self.touching()
            groups = small_components({p: near.get(p, set()) & annotation.pieces for p in sorted(annotation.pieces)})
        return [Annotation(annotation.clauses, frozenset(g), (annotation,)) for g in sorted(groups)]


def _base_annotations(space: Space) -> dict[int, list[Annotation]]:
    """One annotation for every indicator that has a region, by variable."""
    pieces = defaultdict(set)
    for r in space.pieces.select("ind_id", "part_id").distinct().collect():  # pieces, not samples
        pieces[r["ind_id"]].add((r["ind_id"], r["part_id"]))
    out = defaultdict(list)
    for r in space.indicators.indicators.orderBy("var_id", "ord").collect():
        rule = r["rule"]
        made = Interval(rule["lower"], rule["upper"], rule["name"], rule["precision"]) if rule["kind"] == "interval" else Equals(rule["vals"][0], rule["name"]) if rule["kind"] == "eq" else OneOf(frozenset(rule["vals"]), rule["name"])
        if pieces.get(r["ind_id"]):
            out[r["var_id"]].append(Annotation((Clause(r["var_id"], made, frozenset((r["ind_id"],))),), frozenset(pieces[r["ind_id"]])))
    return dict(out)


def extract_annotations(samples: DataFrame, indicators: Indicators, scale_factor: float = 1.0, region_method: str = "kde", kernel: str = "gaussian", contour_level: float = 0.25) -> tuple[Space, dict[int, list[Annotation]]]:
    """Regions of all indicators at once; indicators whose region is empty are left out."""
    if region_method not in ("kde", "rangeset"):
        raise ValueError("region_method must be kde or rangeset")
    scale = embedding_scale(samples, scale_factor)
    grid = Grid.around(samples, scale)
    if region_method == "kde":
        cells = settled(region_cells(binned(samples, grid, indicators.membership), grid, scale, kernel, contour_level))
        pieces = samples_inside(samples, cells, grid, contour_level)
        corners = F.explode(F.array(*[F.struct(F.col(f"p{i}{j}").alias("part_id"), F.concat_ws(",", F.lit("c"), F.col("gx") + i, F.col("gy") + j).alias("at")) for i in (0, 1) for j in (0, 1)]))
        corners = cells.select("ind_id", corners.alias("c")).select("ind_id", "c.part_id", "c.at").where(F.col("part_id") >= 0).distinct()
    else:
        members = indicators.membership.join(samples, "sample_id").select("ind_id", "x", "y")
        pieces = inside_triangles(samples, settled(triangulated(members, scale)), 2 * scale)
        corners = None
    space = Space(samples, indicators, scale, grid, pieces, corners)
    return space, _base_annotations(space)


def merge_overfragmented(space: Space, groups: dict[int, list[Annotation]], min_sample_overlap: float = 0.5, rounds: int | None = None) -> dict[int, list[Annotation]]:
    """Merge annotations of one variable whose rules can be merged and whose regions share at least so much of the
    smaller one, until none is left to merge. All variables go together: one pair count for each round."""
    groups = {v: sorted(a, key=lambda a: a.order) for v, a in groups.items()}
    while rounds is None or rounds > 0:
        flat = [(v, a) for v, own in groups.items() if len(own) > 1 for a in own]
        n, shared = space.pair_shares([a for _, a in flat], same_variable=True)
        near: dict[int, set] = {i: set() for i in range(len(flat))}
        for (i, j), c in shared.items():
            least = min(n.get(i, 0), n.get(j, 0))
            if flat[i][0] == flat[j][0] and flat[i][1].can_merge_with(flat[j][1]) and least and c / least >= min_sample_overlap:
                near[i].add(j)
                near[j].add(i)
        parts = small_components(near)
        if all(len(p) == 1 for p in parts):
            break
        merged = defaultdict(list)
        for p in parts:
            merged[flat[p[0]][0]].append(merge_annotations([flat[i][1] for i in sorted(p)]))
        groups |= {v: sorted(a, key=lambda a: a.order) for v, a in merged.items()}
        rounds = None if rounds is None else rounds - 1
    return groups


def generate_region_annotations(features: DataFrame, embedding: DataFrame, id_col: str = "sample_id", sample_size: int | None = 5000, n_discretization_bins: int = 5, scale_factor: float = 1.0, region_method: str = "kde", kernel: str = "gaussian", contour_level: float = 0.25, merge_min_sample_overlap: float = 0.8, filter_constant_features: bool = True, filter_uninformative_features: bool = True, random_state: int = 0, edges: dict | None = None) -> tuple[Space, dict[int, list[Annotation]]]:
    """From features (id and columns) and embedding (id, x, y) to annotations by variable.

    With more than ``sample_size`` samples, exactly so many are drawn; None takes all. Constant features, and variables of which one
    region is left after merging, are dropped on demand.
    """
    points = embedding.select(F.col(id_col).alias("sample_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    points = settled(points if sample_size is None else sample_exact(points, sample_size, "sample_id", random_state))
    own = features.join(points.select(F.col("sample_id").alias(id_col)), id_col, "left_semi")
    own = settled(constant_filter(own, id_col) if filter_constant_features else own)
    data = ingest(own, id_col)
    indicators = expand(data, n_discretization_bins, edges)
    indicators = Indicators(indicators.indicators.persist(), settled(indicators.membership))
    space, groups = extract_annotations(points, indicators, scale_factor, region_method, kernel, contour_level)
    groups = merge_overfragmented(space, groups, merge_min_sample_overlap)
    if filter_uninformative_features:
        groups = {v: a for v, a in groups.items() if len(a) > 1}
    return space, groups
