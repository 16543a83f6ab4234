"""Benchmark decontamination by a prefix-filtered set join.

The shingles of the benchmark's windows are ordered by how rare they are in the corpus. A window that
stands whole in a document has all of its shingles there, so its rarest one is the necessary prefix:
documents are joined with the windows on it alone. The shingle's place fixes where the window would
begin, the window's length must fit into the document, and what is left is compared word for word.
The benchmark goes to the tasks in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import ids, map_texts, materialize

#: Bytes to word bytes: A-Z lowered, ASCII other than letters and digits to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


class Block:
    """Windows of some benchmark items, as arrays of word numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.window, self.shingle = window, shingle
        self.words: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        self.windows: dict[tuple[int, ...], set[int]] = {}
        for at, (_, text) in enumerate(items):
            own = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            size = min(window, len(own))
            for i in range(len(own) - size + 1) if own else ():
                self.windows.setdefault(tuple(own[i : i + size]), set()).add(at)
        self.base = np.uint64(len(self.words) + 1)
        self.shingles = {n: np.unique(self._all(n)) for n in {min(shingle, len(w)) for w in self.windows}}

    def _all(self, n: int) -> np.ndarray:
        return np.concatenate([self.hashed(np.array(w, np.int64), n) for w in self.windows if min(self.shingle, len(w)) == n])

    def hashed(self, numbers: np.ndarray, n: int) -> np.ndarray:
        """A 64-bit value for each run of n words; runs with a word that the block does not have come out as 0."""
        m = len(numbers) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        numbers = numbers.astype(np.uint64)
        out, known = np.zeros(m, np.uint64), np.ones(m, bool)
        for i in range(n):
            part = numbers[i : i + m]
            out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            known &= part > 0
        return np.where(known, out | np.uint64(1), np.uint64(0))

    def numbers(self, text: str | None) -> np.ndarray:
        found = words_of(text)
        return np.fromiter(map(self.words.get, found, repeat(0)), np.int64, len(found))


def _count(block: Block, numbers: np.ndarray, totals: dict[int, np.ndarray]) -> None:
    for n, known in block.shingles.items():
        own = np.unique(block.hashed(numbers, n))
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        totals[n][at[known[at] == own]] += 1


class Prefixes:
    """From the rarest shingle of each window to the windows that wait for it."""

    def __init__(self, block: Block, rarity: dict[tuple[int, int], int]):
        self.block = block
        self.at: dict[int, dict[int, list[tuple[int, np.ndarray, set[int]]]]] = {}
        for window, owners in block.windows.items():
            n = min(block.shingle, len(window))
            own = block.hashed(np.array(window, np.int64), n).tolist()
            offset = min(range(len(own)), key=lambda i: (rarity.get((n, own[i]), 0), own[i], i))
            self.at.setdefault(n, {}).setdefault(own[offset], []).append((offset, np.array(window, np.int64), owners))
        self.keys = {n: np.array(sorted(found), np.uint64) for n, found in self.at.items()}

    def find(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """(start, end) of every occurrence, and the items that have one."""
        spans, items = [], set()
        for n, keys in self.keys.items():
            hashed = self.block.hashed(numbers, n)
            at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            for i in np.flatnonzero(keys[at] == hashed).tolist():
                for offset, window, owners in self.at[n][int(hashed[i])]:
                    start = i - offset
                    if start >= 0 and start + len(window) <= len(numbers) and np.array_equal(numbers[start : start + len(window)], window):
                        spans.append((start, start + len(window)))
                        items |= owners
        return spans, items


def covered(spans) -> int:
    """Words in the union of (start, end) spans."""
    total, last = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, last))
        last = max(last, end)
    return total


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The items, repeated ones once, in blocks of about so many bytes; one of them is on the driver at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n == 1:
        return [items]
    items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "benchmark")
    return [items.where(F.col("block") == b).drop("block") for b in range(n)]


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """Words of every document that stand inside an occurrence of a benchmark window.

    Columns: id, n_words, n_hit, n_items, items_sha256, contaminated, spans array<struct<start,end>> (in words,
    merged and in order). A window is ``window`` consecutive words of an item; a shorter item, unless empty, is one
    window. Null or empty texts have no words; null item ids do not count as items (their windows still hit).
    Repeated rows give a row each, other columns are not read. Every block of ``block_bytes`` of items is joined
    with all documents, so the benchmark may be of any size.
    """
    kind = df.schema[id_col].dataType.simpleString()
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    parts = [_one_block(df, part, id_col, text_col, window, shingle, kind) for part in blocks]
    if len(parts) == 1:
        found = parts[0]
    else:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("_id", "version", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"), (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"))
        found = found.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    ) if len(parts) > 1 else F.col("spans")
    found = found.withColumn("spans", merged)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(F.col("_id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def _one_block(df: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int, shingle: int, kind: str) -> DataFrame:
    rows = [(r["item"], r["text"]) for r in items.collect()]  # bounded by block_bytes
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(rows)

    def counter():
        block = Block(shared.value, window, shingle)
        totals = {n: np.zeros(len(known), np.int64) for n, known in block.shingles.items()}

        def work(batch: pa.RecordBatch):
            for text in batch.column(1).to_pylist():
                _count(block, block.numbers(text), totals)

        def finish():
            for n, known in block.shingles.items():
                seen = totals[n] > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(seen.sum()), n, np.int32)), pa.array(known[seen].view(np.int64)), pa.array(totals[n][seen])], ["size", "shingle", "n_docs"])

        work.finish = finish  # type: ignore[attr-defined]
        return work

    counts = map_texts(df, id_col, text_col, counter, "size int, shingle bigint, n_docs bigint")
    counts = counts.groupBy("size", "shingle").agg(F.sum("n_docs").alias("n_docs"))
    # as many rows as the block has shingles at most, whatever the corpus
    rarity = spark.sparkContext.broadcast({(r["size"], r["shingle"] % (1 << 64)): r["n_docs"] for r in counts.collect()})

    def finder():
        prefixes = Prefixes(block := Block(shared.value, window, shingle), rarity.value)

        def work(batch: pa.RecordBatch):
            n_words, items, starts = [], [], []
            for text in batch.column(1).to_pylist():
                numbers = block.numbers(text)
                spans, own = prefixes.find(numbers)
                n_words.append(len(numbers))
                items.append(sorted({block.items[i] for i in own if block.items[i] is not None}))
                merged: list[dict] = []
                for s, e in sorted(spans):
                    if merged and s <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], e)
                    else:
                        merged.append({"start": s, "end": e})
                starts.append(merged)
            version = [hashlib.md5((t or "").encode()).digest() for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([ids(batch), pa.array(version, pa.binary()), pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["_id", "version", "n_words", "items", "spans"])

        return work

    return map_texts(df, id_col, text_col, finder, f"_id {kind}, version binary, n_words bigint, items array<string>, spans array<struct<start:int,end:int>>")
