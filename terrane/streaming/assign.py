"""Indicators of a stream of samples: with fixed edges every row is placed alone, so no state is kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.encode import IND
from terrane.sources.shared import shared_folder


def indicators_of(values: dict[int, Column], edges: dict[int, list[float]]) -> Column:
    """The array of indicator ids of a row; missing values are in no bin."""

    def place(v: int, c: Column) -> Column:
        c = F.nullif(c.cast("double"), F.lit(float("nan")))
        at = sum((F.when(c >= e, 1).otherwise(0) for e in edges[v]), F.lit(0))
        return F.when(c.isNotNull(), F.lit(v * IND) + at).cast("long")

    return F.array_compact(F.array(*[place(v, c) for v, c in values.items()]))


def assign(samples: DataFrame, columns: list[str], edges: dict[int, list[float]], id_col: str = "sample_id") -> DataFrame:
    """(ind_id, id) for batches and streams alike."""
    return samples.select(F.explode(indicators_of({i: F.col(c) for i, c in enumerate(columns)}, edges)).alias("ind_id"), id_col)


def assign_once(spark: SparkSession, sf_dir: str, edges: dict[int, list[float]]) -> DataFrame:
    """Read ``embeddings`` as a stream, place what is there and return the rows written."""
    static = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "embeddings*.parquet" if not _is_folder(spark, f"{sf_dir}/embeddings.parquet") else "*.parquet").parquet(f"{sf_dir}/embeddings.parquet" if _is_folder(spark, f"{sf_dir}/embeddings.parquet") else sf_dir)
    part = lambda i: F.col("embedding")[i].cast("double")
    rows = assign(stream.select(F.col("vec_id").alias("sample_id"), part(0).alias("x"), part(1).alias("y")), ["x", "y"], edges)
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
