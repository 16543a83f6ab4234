"""Parquet sources."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table of rows that the driver holds, as a relation of known size: Spark broadcasts it only where it is
    small, and then shuffles nothing of what it is joined with. (Rows given as they are have no size for Spark, so that
    a join with them shuffles the samples.)"""
    rows, kind = list(rows), StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), kind)


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, x, y, e0 .. e3 and label of the ``embeddings`` table; x and y are its first two components."""
    part = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), part(0).alias("x"), part(1).alias("y"), *[part(i).alias(f"e{i}") for i in range(4)], F.col("label").cast("string").alias("label"))
