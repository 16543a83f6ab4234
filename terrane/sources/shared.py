"""Tables that cut a long lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a local run gets one of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="terrane-"))
        found = _own[0]
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: later plans start from the files, with the files' size as
    their estimate, also when executors are lost. (A checkpoint keeps the estimate of the plan it cuts, which a
    loop of joins multiplies up without end.)"""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
