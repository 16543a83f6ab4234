"""Rules that say which values of a variable an indicator holds, as values and as columns.

A rule column is a struct (kind, lower, upper, vals, name, precision): kind ``interval`` uses the bounds,
``eq`` and ``oneof`` the sorted distinct values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import total_ordering

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RULE = "struct<kind:string,lower:double,upper:double,vals:array<string>,name:string,precision:int>"
#: Fixed tolerances: bounds this near count as touching.
RTOL, ATOL = 1e-5, 1e-8


class IncompatibleRules(ValueError):
    """Rules that cannot be merged."""


class IncompatibleIndicators(ValueError):
    """Indicators that cannot be merged."""


def close(a: float, b: float) -> bool:
    return a == b or (math.isfinite(a) and math.isfinite(b) and abs(a - b) <= ATOL + RTOL * abs(b))


def _key(v):
    return (isinstance(v, str), v)


@total_ordering
@dataclass(frozen=True)
class Interval:
    """Values between two bounds; an infinite one is open. Equal if the bounds are; ordered by the lower one."""

    lower: float | None = None
    upper: float | None = None
    name: str = field(default="x", compare=False)
    precision: int = field(default=2, compare=False)

    def __post_init__(self):
        if self.lower is None and self.upper is None:
            raise ValueError("an interval needs a bound")
        object.__setattr__(self, "lower", -math.inf if self.lower is None else self.lower)
        object.__setattr__(self, "upper", math.inf if self.upper is None else self.upper)

    def can_merge_with(self, other) -> bool:
        if not isinstance(other, Interval):
            return False
        touch = close(self.lower, other.upper) or close(self.upper, other.lower)
        inside = any(a.lower <= p <= a.upper for a, b in ((self, other), (other, self)) for p in (b.lower, b.upper))
        return touch or inside

    def merge_with(self, other) -> Interval:
        if not self.can_merge_with(other):
            raise IncompatibleRules(f"{self} and {other} cannot be merged")
        return replace(self, lower=min(self.lower, other.lower), upper=max(self.upper, other.upper), precision=max(self.precision, other.precision))

    def contains(self, other) -> bool:
        return isinstance(other, Interval) and self.lower <= other.lower and other.upper <= self.upper

    def __lt__(self, other) -> bool:
        return self.lower < other.lower if isinstance(other, Interval) else NotImplemented

    def _text(self, v: float) -> str:
        return f"{v:.{self.precision}f}" if self.precision >= 0 else str(int(round(v, self.precision)))

    def __str__(self) -> str:
        if math.isinf(self.upper):
            return f"{self.name} > {self._text(self.lower)}"
        start = "" if math.isinf(self.lower) else f"{self._text(self.lower)} < "
        return f"{start}{self.name} < {self._text(self.upper)}"


class _Values:
    """What rules on single values share."""

    def can_merge_with(self, other) -> bool:
        return isinstance(other, _Values)

    def merge_with(self, other) -> OneOf:
        if not self.can_merge_with(other):
            raise IncompatibleRules(f"{self} and {other} cannot be merged")
        return OneOf(self.values | other.values, self.name)

    def __lt__(self, other):
        return _key(min(self.values, key=_key)) < _key(min(other.values, key=_key)) if isinstance(other, _Values) else NotImplemented


@total_ordering
@dataclass(frozen=True)
class Equals(_Values):
    value: object
    name: str = field(default="x", compare=False)
    __lt__ = _Values.__lt__

    @property
    def values(self) -> frozenset:
        return frozenset((self.value,))

    def contains(self, other) -> bool:
        return isinstance(other, Equals) and other == self

    def __str__(self) -> str:
        return f"{self.name} = {self.value}"


@total_ordering
@dataclass(frozen=True)
class OneOf(_Values):
    values: frozenset
    name: str = field(default="x", compare=False)
    __lt__ = _Values.__lt__

    def __post_init__(self):
        object.__setattr__(self, "values", frozenset(self.values))

    def contains(self, other) -> bool:
        return isinstance(other, _Values) and self.values >= other.values

    def __str__(self) -> str:
        return f"{self.name} in {{{', '.join(map(str, sorted(self.values, key=_key)))}}}"


def merge_rules(rules: list) -> list:
    """Left fold over the sorted distinct rules of one variable: each joins the rule before it if it can."""
    out: list = []
    for rule in sorted(set(rules)):
        if out and out[-1].can_merge_with(rule):
            out[-1] = out[-1].merge_with(rule)
        else:
            out.append(rule)
    return out


# ---- columns


def interval(lower: Column, upper: Column, name: Column, precision: int = 2) -> Column:
    return F.struct(F.lit("interval").alias("kind"), lower.cast("double").alias("lower"), upper.cast("double").alias("upper"), F.lit(None).cast("array<string>").alias("vals"), name.alias("name"), F.lit(precision).alias("precision"))


def values(vals: Column, name: Column) -> Column:
    vals = F.array_sort(F.array_distinct(vals))
    none = F.lit(None).cast("double")
    return F.struct(F.when(F.size(vals) == 1, "eq").otherwise("oneof").alias("kind"), none.alias("lower"), none.alias("upper"), vals.alias("vals"), name.alias("name"), F.lit(0).alias("precision"))


def is_close(a: Column, b: Column) -> Column:
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return (a == b) | (finite & (F.abs(a - b) <= ATOL + RTOL * F.abs(b)))


def can_merge(a: Column, b: Column) -> Column:
    both = (a["kind"] == "interval") & (b["kind"] == "interval")
    touch = is_close(a["lower"], b["upper"]) | is_close(a["upper"], b["lower"])
    overlap = (a["lower"] <= b["upper"]) & (b["lower"] <= a["upper"])
    return F.when(both, touch | overlap).otherwise((a["kind"] != "interval") & (b["kind"] != "interval"))


def merge(a: Column, b: Column) -> Column:
    """Null where the rules cannot be merged."""
    both = a["kind"] == "interval"
    hull = F.struct(a["kind"].alias("kind"), F.least(a["lower"], b["lower"]).alias("lower"), F.greatest(a["upper"], b["upper"]).alias("upper"), a["vals"].alias("vals"), a["name"].alias("name"), F.greatest(a["precision"], b["precision"]).alias("precision"))
    none = F.lit(None).cast("double")
    union = F.struct(F.lit("oneof").alias("kind"), none.alias("lower"), none.alias("upper"), F.array_sort(F.array_union(a["vals"], b["vals"])).alias("vals"), a["name"].alias("name"), a["precision"].alias("precision"))
    return F.when(can_merge(a, b), F.when(both, hull).otherwise(union))


def contains(a: Column, b: Column) -> Column:
    inside = (b["kind"] == "interval") & (a["lower"] <= b["lower"]) & (b["upper"] <= a["upper"])
    same = (b["kind"] == "eq") & (a["vals"] == b["vals"])
    superset = b["kind"].isin("eq", "oneof") & (F.size(F.array_except(b["vals"], a["vals"])) == 0)
    return F.coalesce(F.when(a["kind"] == "interval", inside).when(a["kind"] == "eq", same).otherwise(superset), F.lit(False))


def rule_order(r: Column) -> Column:
    """Sort key within one variable."""
    return F.struct(r["lower"], r["upper"], r["vals"])


def text(rule: Column) -> Column:
    """The rule as text; decimals round half to even on the binary value, so they are formatted in Python."""

    @F.pandas_udf("string")
    def write(lower: pd.Series, upper: pd.Series, vals: pd.Series, name: pd.Series, kind: pd.Series, precision: pd.Series) -> pd.Series:
        def one(lo, up, v, n, k, p):
            if k == "interval":
                return str(Interval(lo, up, n, int(p)))
            return f"{n} = {v[0]}" if k == "eq" else f"{n} in {{{', '.join(v)}}}"

        return pd.Series([one(*x) for x in zip(lower, upper, vals, name, kind, precision)])

    return write(rule["lower"], rule["upper"], rule["vals"], rule["name"], rule["kind"], rule["precision"])
