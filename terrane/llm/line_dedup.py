"""Line deduplication over levelled sorted runs of line hashes, with DataFrame functions only.

Documents come in batches. The distinct line keys of a batch, sorted by hash, are merge-anti-joined with the
runs of the batches before it: keys that no run holds are the batch's own run, a sorted run of level 0; the
others are noted as seen again. So the runs hold every key once. When a level is full its runs are compacted
into one run of the next level. Keys noted as seen again or several times in a batch, in enough documents in
all, lose their lines in all documents but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import BLANKS, ascii_lower, discard, materialize


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits, so that no two keys of a large corpus meet by chance."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


class LineRuns:
    """Levelled runs of (h1, h2, n_docs, last_doc), each sorted by its hashes, that together hold every key once, and the
    same columns for the keys that later batches held again."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.again: list[DataFrame] = []

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h1, h2, doc) rows, one for each document and key."""
        batch = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))
        runs = self.runs()
        if runs:
            held = _united(runs).select("h1", "h2", F.lit(True).alias("held"))
            # one merge tells the batch's new keys, an anti-join's rows, from the others, a semi-join's
            batch = batch.join(held, ["h1", "h2"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
            batch = materialize(batch.sortWithinPartitions("h1", "h2"), "line-batch", ["held"])
            self.again.append(batch.where("held").drop("held"))
            self.levels[0].append(batch.where("NOT held").drop("held"))  # its files hold what was seen again too, and stay
        else:
            self.levels[0].append(materialize(batch.sortWithinPartitions("h1", "h2"), "line-run"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(materialize(_united(full).repartition("h1", "h2").sortWithinPartitions("h1", "h2"), "line-run"))
            for old in full:
                discard(old)
            level += 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, last_doc) of the keys that stand in so many documents."""
        every = _united([*self.runs(), *self.again])
        if self.again:
            every = every.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return every.where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc")


def _united(runs: list[DataFrame]) -> DataFrame:
    both = runs[0]
    for run in runs[1:]:
        both = both.unionByName(run)
    return both


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batch_docs: int = 1 << 30, fanout: int = 3) -> DataFrame:
    """Drop the lines whose key stands in at least ``min_docs`` documents, except in the largest id that holds it.

    A key is the line without blanks at its ends, A-Z in lower case; keys of fewer than ``min_chars`` code points
    never count. A batch has about ``batch_docs`` documents, a level up to ``fanout`` - 1 runs. All columns of ``df`` stay, with the kept lines in ``text_col``; n_lines and n_dropped are added
    (columns of these names are replaced). A null or empty text is one empty line. Every row counts as a document;
    rows of equal id and text are treated alike, rows without id keep their lines and raise no key's largest id.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    found = rows.select("doc", F.explode(F.array_distinct(F.transform(keys, key_hash))).alias("k"))
    batches = max(4, -(-df.count() // batch_docs))  # four at least, so that the runs are compacted at every size
    found = found.select(F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch"), "k.h1", "k.h2", "doc")
    found = materialize(found, "line-keys", ["batch"])
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(found.where(F.col("batch") == b))
    discard(found)
    repeated = materialize(runs.repeated(min_docs), "repeated-lines")  # a table of its own, so that the join can split a hot line
    placed = rows.select("doc", F.xxhash64("text").alias("version"), F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"))
    placed = placed.where(F.length("key") >= min_chars).select("doc", "version", "pos", key_hash(F.col("key")).alias("k")).select("doc", "version", "pos", "k.h1", "k.h2")
    dropped = placed.join(repeated, ["h1", "h2"]).where(F.col("doc") < F.col("last_doc"))
    dropped = dropped.groupBy("doc", "version").agg(F.collect_set("pos").alias("_gone"))
    dropped = dropped.select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), "_gone")
    kept = [c for c in df.columns if c not in ("n_lines", "n_dropped", "_doc", "_version", "_gone", "_lines")]
    base = df.select(*[F.col(f"`{c}`") for c in kept])
    out = base.join(dropped, (F.col(id_col) == F.col("_doc")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_version")), "left")
    out = out.withColumn("_lines", lines_of(F.col(text_col)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    text = F.array_join(F.transform(stay, lambda i: F.element_at(F.col("_lines"), i + 1)), "\n")
    changed = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(text)
    return out.select(*[changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept], F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
