"""The tables behind the plots: values, bands, colours and places, without any drawing."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AGGREGATES = ("max", "sum")


def feature_values(df: DataFrame, names: list[str], id_col: str, binary: bool = False, threshold: float = 0.0, log: bool = False, agg: str = "max") -> DataFrame:
    """(id, value): whether any of the columns is above the threshold, or their maximum or sum, on demand as
    log(1 + value); with ``z``, the place in drawing order, low values first."""
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {AGGREGATES}")
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    columns = [F.col(f"`{n}`").cast("double") for n in names]
    if binary:
        value = F.exists(F.array(*columns), lambda c: c > threshold).cast("double")
    elif agg == "max":
        value = F.greatest(*columns) if len(columns) > 1 else columns[0]
    else:
        value = sum(columns[1:], columns[0])
    return df.select(id_col, (F.log1p(value) if log else value).alias("value"))


def marker_values(df: DataFrame, groups: dict[str, list[str]], id_col: str, **kw) -> DataFrame:
    """``feature_values`` of every group of columns, with the group's name."""
    out = None
    for name, columns in groups.items():
        own = feature_values(df, columns, id_col, **kw).withColumn("name", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def density_bands(density: DataFrame, levels: int = 5) -> DataFrame:
    """(ind_id, gx, gy, band) of the grid points, by the scaled density."""
    return density.select("ind_id", "gx", "gy", F.least(F.floor(F.col("z_max") * levels), F.lit(levels - 1)).cast("int").alias("band"))


def wrapped(text: Column, width: int = 40) -> Column:
    """Every line of a description broken at blanks into lines of at most ``width`` characters."""
    @F.pandas_udf("string")
    def wrap(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "\n".join("\n".join(textwrap.wrap(line, width)) for line in t.split("\n")))

    return wrap(text)


def purity_alpha(purity: Column, alpha: float = 1.0) -> Column:
    return alpha * (0.75 * purity + 0.25)


def sample_colors(inside: DataFrame, colors: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(sample_id, color): the colour of the last region that holds the sample; ``members`` keeps those of its rule."""
    rows = inside if members is None else inside.join(members, ["ra_id", "sample_id"], "left_semi")
    return rows.join(colors, "ra_id").groupBy("sample_id").agg(F.max_by("color", "ra_id").alias("color"))


def panel_grid(panels: DataFrame, per_row: int = 4) -> DataFrame:
    """Row, column and letter of every panel (panel from 0)."""
    p = F.col("panel")
    return panels.withColumns({"row": F.floor(p / per_row).cast("int"), "col": F.pmod(p, F.lit(per_row)).cast("int"), "letter": F.chr(97 + F.pmod(p, F.lit(26)))})


def variable_colors(rows: DataFrame, n_colors: int) -> DataFrame:
    """The same colour number for the same description in every panel; few descriptions, one sort."""
    return rows.withColumn("color", F.pmod(F.dense_rank().over(W.orderBy("descriptor")) - 1, F.lit(n_colors)).cast("int"))


def discretization_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bucket, n): even buckets over the range of a column, the last one closed."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if lo is None or lo == hi:
        return df.where(F.col(column).isNotNull()).groupBy(F.lit(0).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    bucket = F.least(F.floor((F.col(column) - lo) / ((hi - lo) / bins)).cast("int"), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def graph_segments(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """(src, dst, x0, y0, x1, y1) of every edge once."""
    one = edges.where(F.col("src") < F.col("dst"))
    a = samples.select(F.col("sample_id").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = samples.select(F.col("sample_id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return one.join(a, "src").join(b, "dst").select("src", "dst", "x0", "y0", "x1", "y1")


def subregions(annotations: list, palette: list[str]) -> tuple[list[tuple[int, int, str]], list]:
    """(place of the annotation, place among its parts, colour) of the annotations that each was made from, coloured
    with the palette in turn, and these annotations."""
    rows, parts = [], []
    for k, a in enumerate(annotations):
        for i, leaf in enumerate(a.leaves()):
            rows.append((k, i, palette[i % len(palette)]))
            parts.append(leaf)
    return rows, parts


def hue_color(hue: Column, step: Column, steps: int, min_saturation: float = 0.0) -> Column:
    """Colour (r, g, b from 0 to 1) of full value: one of ``steps`` even saturations from the least one to 1."""
    saturation = min_saturation + (1 - min_saturation) * step / max(1, steps - 1)

    def part(n: int) -> Column:
        k = F.pmod(n + hue * 6, F.lit(6.0))
        return 1 - saturation * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(part(5).alias("r"), part(3).alias("g"), part(1).alias("b"))


def hue_of(color: Column) -> Column:
    """Hue (0 up to 1) of a colour (r, g, b); 0 for a grey."""
    r, g, b = color["r"], color["g"], color["b"]
    top, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    sixth = F.when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.when(span > 0, sixth / 6).otherwise(0.0)
