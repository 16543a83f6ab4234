"""A training-data pipeline over ``documents``: every stage works on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last one token ids; other columns
of ``docs`` are left behind, whatever their names. Rows are judged by doc_id and text; any other column may be null.
Rows without text go in the first stage; rows without doc_id are documents of their own. Rows of one doc_id with
different texts are kept apart; rows of equal doc_id and text are copies, of which the near-copy stage keeps one.
Without rows every stage returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.bpe import byte_bpe
from terrane.llm.common import materialize, parted
from terrane.llm.decontaminate import find_contamination
from terrane.llm.langid import identified, train
from terrane.llm.line_dedup import dedup_lines
from terrane.llm.minhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, or unlike every language, go."""
    return identified(docs.select(COLUMNS), train(docs))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; documents of which nothing stays go."""
    out = dedup_lines(docs.select(COLUMNS))
    left = (F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")) & (F.trim("text") != "")
    return out.where(left).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays, the one of the smallest doc_id; of rows that repeat it one."""
    found = materialize(near_duplicates(docs), "copies").where(F.col("doc_id").isNotNull())
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"))
    some, rest = _touched(docs, gone.unionByName(twice))
    return some.join(gone, F.col("doc_id") == F.col("_id"), "left_anti").dropDuplicates(["doc_id", "text"]).unionByName(rest)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; of rows of one doc_id all, if one does."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = materialize(found.where("contaminated").select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct(), "contaminated")
    some, rest = _touched(docs, gone)
    return some.join(gone, F.col("doc_id") == F.col("_id"), "left_anti").unionByName(rest)


def _touched(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id may be one of the ids, all others, those without doc_id among them): of the texts only the
    first are shuffled later."""
    named = docs.select(COLUMNS).where(F.col("doc_id").isNotNull())
    some, rest = parted(named, [F.col("doc_id")], ids, [F.col("_id")])
    return some, rest.unionByName(docs.select(COLUMNS).where(F.col("doc_id").isNull()))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    import public_tokenizers

    out = byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)
    return out.drop("decoded")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", new_lines),
    ("minhash_dedup", no_near_copies),
    ("decontaminate", no_benchmarks),
    ("byte_bpe", token_ids),
]

#: Trained models, signatures and merges are not for SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written to the shared folder, where the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
