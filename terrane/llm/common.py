"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

#: Bound of what ``parted`` broadcasts, in numbers.
BUCKETS = 1 << 18

#: A Python worker looks at this many bytes of text at once.
SLICE_BYTES = 8 << 20
#: Bound of one Arrow batch, so that very long texts do not pile up in a worker.
ARROW_BYTES = 16 << 20


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run, in which all
    share the machine's folders, gets one of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="terrane-")
        shared_dir.own = found  # type: ignore[attr-defined]
    return found.rstrip("/")


def workspace(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/terrane/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = workspace(spark, what)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.terrane_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that no later plan reads."""
    path = getattr(df, "terrane_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_workspace(spark: SparkSession) -> None:
    """Remove all tables that operators have left in the shared folder; no result that still reads them works then."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/terrane")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucket(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def parted(rows: DataFrame, row_key: list[Column], keys: DataFrame, key: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a partner among the keys, rows that have none), without a shuffle of the rows: of the
    keys only the hash buckets that they fall into are broadcast, ``BUCKETS`` numbers at most."""
    hit = F.broadcast(keys.select(bucket(*key).alias("_hit")).distinct())
    marked = rows.withColumn("_bucket", bucket(*row_key))
    on = F.col("_bucket") == F.col("_hit")
    return marked.join(hit, on, "left_semi").drop("_bucket"), marked.join(hit, on, "left_anti").drop("_bucket")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def slices(batch: pa.RecordBatch, text: str = "_text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; a longer single row stands alone."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def map_texts(df: DataFrame, id_col: str, text_col: str, worker: Callable[[], Callable], schema: str, extra: dict[str, Column] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """Run ``worker()(batch)`` over (_id, _text, extras) slices; the callable returns a RecordBatch or None.

    Only the named columns are read, so other columns of ``df``, whatever they are called, cannot clash.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[c.alias(k) for k, c in (extra or {}).items()])

    def run(batches):
        work = None
        for batch in batches:
            for part in slices(batch, limit=limit):
                work = work or worker()
                out = work(part)
                if out is not None:
                    yield out
        end = getattr(work, "finish", None)
        if end is not None:
            yield from end()

    return source.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch) -> list[str]:
    """Texts of a slice; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index("_text")).to_pylist()]


def ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("_id"))


def fold(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fixed deal of documents into folds."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(doc_id, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n
