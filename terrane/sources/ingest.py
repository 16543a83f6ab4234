"""Feature tables as variables in long form, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.sources.tables import small_table

CONTINUOUS, DISCRETE = "continuous", "discrete"


class UnsupportedColumn(ValueError):
    """A column whose type can be no variable."""


def kind_of(field: T.StructField, categorical: set[str] = frozenset(), strict: bool = False) -> str:
    """Numbers and booleans are continuous, strings and columns named as categorical discrete."""
    if field.name in categorical:
        return DISCRETE
    if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
        return CONTINUOUS
    if isinstance(field.dataType, T.StringType) and not strict:
        return DISCRETE
    raise UnsupportedColumn(f"column {field.name!r} of type {field.dataType.simpleString()} is neither continuous nor discrete")


def number(c: Column) -> Column:
    """As double; NaN counts as missing."""
    return F.nullif(c.cast("double"), F.lit(float("nan")))


@dataclass
class Ingested:
    """variables(var_id, name, kind, categories, ordered), numbers(sample_id, var_id, value) and
    levels(sample_id, var_id, level, code)."""

    variables: DataFrame
    numbers: DataFrame
    levels: DataFrame


def ingest(df: DataFrame, id_col: str, categorical: set[str] = frozenset(), ordered: dict[str, list[str]] | None = None, strict: bool = False) -> Ingested:
    """One variable for every column but the id. Levels are sorted unless ``ordered`` lists them for a column;
    values not listed there are missing. Missing values give no row."""
    ordered = ordered or {}
    fields = [f for f in df.schema.fields if f.name != id_col]
    kinds = {f.name: kind_of(f, set(categorical) | set(ordered), strict) for f in fields}
    var_id = {f.name: i for i, f in enumerate(fields)}
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("sample_id"), *[(number(F.col(f"`{n}`")) if k == CONTINUOUS else F.col(f"`{n}`").cast("string")).alias(str(var_id[n])) for n, k in kinds.items()])

    def long(kind: str, value: str, empty: str) -> DataFrame:
        own = [str(var_id[n]) for n, k in kinds.items() if k == kind]
        if not own:
            return base.select("sample_id", F.lit(0).alias("var_id"), F.lit(None).cast(empty).alias(value)).where(F.lit(False))
        return base.unpivot(["sample_id"], own, "var", value).where(F.col(value).isNotNull()).select("sample_id", F.col("var").cast("int").alias("var_id"), value)

    numbers, levels = long(CONTINUOUS, "value", "double"), long(DISCRETE, "level", "string")
    listed = {var_id[n]: v for n, v in ordered.items()}
    found = levels.where(~F.col("var_id").isin(*listed)) if listed else levels
    found = found.groupBy("var_id").agg(F.array_sort(F.collect_set("level")).alias("categories"))
    names = small_table(spark, [(var_id[n], n, k, n in ordered, listed.get(var_id[n])) for n, k in kinds.items()], "var_id int, name string, kind string, ordered boolean, given array<string>")
    variables = names.join(found, "var_id", "left").select("var_id", "name", "kind", F.coalesce("given", "categories").alias("categories"), "ordered")
    coded = levels.join(variables.select("var_id", "categories"), "var_id")
    coded = coded.withColumn("code", (F.array_position("categories", F.col("level")) - 1).cast("double")).where(F.col("code") >= 0)
    return Ingested(variables, numbers, coded.select("sample_id", "var_id", "level", "code"))


def predicates(variables: DataFrame, indicators: DataFrame) -> DataFrame:
    """(name, is_discrete, is_continuous, is_indicator, is_derived) of variables and of the indicators (var, ...) made
    from them; an indicator is derived from its variable."""
    flag = lambda v: F.lit(v)
    own = variables.select("name", (F.col("kind") == DISCRETE).alias("is_discrete"), (F.col("kind") == CONTINUOUS).alias("is_continuous"), flag(False).alias("is_indicator"), flag(False).alias("is_derived"))
    return own.unionByName(indicators.select(F.col("var").alias("name"), flag(False).alias("is_discrete"), flag(False).alias("is_continuous"), flag(True).alias("is_indicator"), flag(True).alias("is_derived")))


def to_wide(data: Ingested, ids: DataFrame) -> DataFrame:
    """The feature table again: a column for each variable, levels decoded."""
    rows = data.variables.orderBy("var_id").collect()  # a row for each column of the input
    wide = ids.select("sample_id").distinct()
    for kind, long, value in ((CONTINUOUS, data.numbers, "value"), (DISCRETE, data.levels, "level")):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        if kind == DISCRETE:
            long = long.join(data.variables.select("var_id", "categories"), "var_id").withColumn("level", F.element_at("categories", F.col("code").cast("int") + 1))
        part = long.groupBy("sample_id").pivot("var_id", [r["var_id"] for r in own]).agg(F.first(value))
        wide = wide.join(part.select("sample_id", *[F.col(f"`{r['var_id']}`").alias(r["name"]) for r in own]), "sample_id", "left")
    return wide.select("sample_id", *[f"`{r['name']}`" for r in rows])


def sample_exact(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), uniform, without replacement and the same in every run."""
    draw = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("_draw", draw).orderBy("_draw", id_col).limit(n).drop("_draw")
