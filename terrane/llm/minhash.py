"""Near-duplicate documents by MinHash, banding, signature and set verification, and components.

Documents of equal shingle sets form one class, which its smallest id stands for. The classes' signatures
(minima of universal hashes) are cut into bands; classes that share a band meet. In every bucket all are
first compared with the smallest one; what does not come into its component that way is then compared
with every member of the other components of the bucket on whole sets, within tasks of bounded size that return
links only. So no candidate pair is left out, and neither the pairs within a component nor those that fail are listed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.bpe import _Numbered
from terrane.llm.common import ids, map_texts, materialize
from terrane.llm.components import connected_components

_MIX = np.uint64(0x9E3779B97F4A7C15)
SLICE = 2 << 20
#: Sets of two blocks are in a task at once.
BLOCK = 512


def shingle_sets(docs: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's word shingles; A-Z lowered, words [^\\x20\\x09-\\x0D]+."""
    number = _Numbered()
    words = [d.encode().lower().split() for d in docs]
    own = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words]
    del words
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    out = []
    for w in own:
        if not len(w):
            out.append(np.zeros(0, np.uint64))
            continue
        n = min(size, len(w))
        h, m = hashed[w], len(w) - n + 1
        code = np.full(m, n, np.uint64)
        for i in range(n):
            code = (code ^ h[i : i + m]) * _MIX
            code ^= code >> np.uint64(32)
        out.append(np.unique(code))
    return out


class Universal:
    """x -> (a x + b) >> 32 over 64-bit words, for a fixed family of odd a."""

    def __init__(self, n: int, seed: int = 20):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, n, dtype=np.uint64)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set (none may be empty), a column for each hash function, as int32."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), len(self.a)), np.int32)
        for i, (a, b) in enumerate(zip(self.a, self.b)):
            out[:, i] = np.minimum.reduceat((flat * a + b) >> np.uint64(32), starts).astype(np.uint32).view(np.int32)
        return out


def bands_for(threshold: float, rows: int, miss: float = 1e-5) -> int:
    """Bands such that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _profile(df: DataFrame, id_col: str, text_col: str, shingle: int, hashes: int) -> DataFrame:
    def worker():
        family = Universal(hashes)

        def work(batch: pa.RecordBatch):
            sets = shingle_sets([x or "" for x in batch.column(1).to_pylist()], shingle)
            full = [s for s in sets if len(s)]
            signed = iter(family.minima(full)) if full else iter(())
            key = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            signature = [next(signed) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([ids(batch), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(signature, pa.list_(pa.int32()))], ["id", "n", "key", "signature"])

        return work

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, worker, f"id {kind}, n bigint, key binary, signature array<int>", limit=SLICE)


def _sets(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def worker():
        def work(batch: pa.RecordBatch):
            sets = shingle_sets([x or "" for x in batch.column(1).to_pylist()], shingle)
            return pa.RecordBatch.from_arrays([ids(batch), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "shingles"])

        return work

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, worker, f"id {kind}, shingles array<bigint>", limit=SLICE)


def cross_links(sets: list[np.ndarray], component: np.ndarray, minor: np.ndarray, percent: int, rows: int = 256) -> np.ndarray:
    """(i, j) of one pair for each minor document i and each other component with a document j that reaches the
    similarity. Common shingles are counted as matrix products, some columns at a time."""
    n = np.array([len(x) for x in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    common = np.flatnonzero(np.bincount(column, minlength=len(values)) > 1)
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    column = place[column]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    who = np.flatnonzero(minor)
    out = []
    for lo in range(0, len(who), rows):
        own = who[lo : lo + rows]
        shared = np.zeros((len(own), len(sets)), np.float32)
        slot = np.full(len(sets), -1)
        slot[own] = np.arange(len(own))
        for c in range(0, len(common), 1024):
            at = slice(*np.searchsorted(column, [c, c + 1024]))
            every = np.zeros((len(sets), 1024), np.float32)
            every[row[at], column[at] - c] = 1
            shared += every[own] @ every.T
        near = 100 * shared >= percent * (n[own][:, None] + n - shared)
        near &= component[own][:, None] != component
        i, j = np.nonzero(near)
        if len(i):
            _, first = np.unique(np.column_stack((i, np.unique(component, return_inverse=True)[1][j])), axis=0, return_index=True)
            out.append(np.column_stack((own[i[first]], j[first])))
    return np.concatenate(out) if out else np.zeros((0, 2), int)


def _alike(n_a: Column, n_b: Column, percent: int) -> Column:
    """Sets of these sizes can reach the similarity."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


class NearDuplicates:
    """One run over a table of documents; ``groups`` gives the result."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, rows: int):
        self.df, self.id_col, self.text_col = df, id_col, text_col
        self.shingle, self.percent, self.rows = shingle, percent, rows
        self.bands = bands_for(percent / 100, rows)

    def _verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the similarity."""
        hashes = self.bands * self.rows
        sure = self.percent / 100 - 5 * math.sqrt(self.percent / 100 * (1 - self.percent / 100) / hashes)
        own = classes.select("id", "n", "signature")
        both = pairs.join(own.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b")), "b")
        both = both.join(own.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a")), "a")
        same = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda e: e))
        both = both.where(_alike(F.col("n_a"), F.col("n_b"), self.percent)).where(same >= math.floor(sure * hashes))
        both = materialize(both.select("a", "b", "n_a", "n_b"), "pairs")
        wanted = both.select(F.col("a").alias("id")).unionByName(both.select(F.col("b").alias("id"))).distinct()
        texts = self.df.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text")).join(wanted, "id", "left_semi")
        sets = materialize(_sets(texts, "id", "text", self.shingle), "sets")
        full = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("x_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x_a")), "a")
        common = F.size(F.array_intersect("x_a", "x_b"))
        return full.where(100 * common >= self.percent * (F.size("x_a") + F.size("x_b") - common)).select("a", "b")

    def _crossing(self, mixed: DataFrame) -> DataFrame:
        """Links (a, b) between the components that meet in the groups of (major, id, component). Only what is not of a
        group's largest component, its minor documents, is compared with all: blocks of minor documents meet blocks of
        the group, and a task returns a link for each minor document and component at most."""
        percent = self.percent
        minor = F.col("component") != F.col("major")
        size = mixed.groupBy("major").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count(F.when(minor, 1)) / BLOCK).cast("int").alias("minors"))
        size = materialize(size, "groups")
        dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        rows = mixed.join(size, "major").where(F.col("minors") > 0)
        asking = rows.where(minor).select("major", "id", "component", F.lit(True).alias("asks"), dealt("minors").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
        asked = rows.select("major", "id", "component", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("minors") - 1)).alias("i"), dealt("blocks").alias("j"))
        texts = self.df.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text")).join(mixed.select("id").distinct(), "id", "left_semi")
        sets = materialize(_sets(texts, "id", "text", self.shingle), "sets")
        kind = mixed.schema["id"].dataType.simpleString()

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            asks = pdf.groupby("id")["asks"].transform("any")
            pdf = pdf.assign(asks=asks).drop_duplicates(["id"]).reset_index(drop=True)
            found = cross_links(pdf["shingles"].tolist(), pdf["component"].to_numpy(), pdf["asks"].to_numpy(bool), percent)
            names = pdf["id"].to_numpy()
            return pd.DataFrame({"a": names[found[:, 0]], "b": names[found[:, 1]]})

        return asking.unionByName(asked).join(sets, "id").groupBy("major", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}").distinct()

    def groups(self) -> DataFrame:
        profile = materialize(_profile(self.df, self.id_col, self.text_col, self.shingle, self.bands * self.rows), "profile")
        named = profile.where(F.col("id").isNotNull() & F.col("key").isNotNull())
        first = named.groupBy("key").agg(F.min(F.struct("id", "n", "signature")).alias("first"), F.count(F.lit(1)).alias("copies"))
        classes = materialize(first.select("key", "copies", "first.id", "first.n", "first.signature"), "classes")
        cut = [F.xxhash64(F.lit(i), F.slice("signature", i * self.rows + 1, self.rows)) for i in range(self.bands)]
        placed = classes.select("id", F.explode(F.array(*cut)).alias("bucket"))
        least = placed.groupBy("bucket").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        least = materialize(least, "shared-buckets")  # a table of its own, so that the join can split a hot bucket
        placed = materialize(placed.join(least, "bucket").select("bucket", "id", "least", "size"), "buckets")
        stars = placed.where(F.col("id") > F.col("least")).select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
        links = materialize(self._verified(stars, classes), "links")
        joined = connected_components(links)
        # buckets in which more than one component is left: gathered by the largest component in them
        inside = placed.where(F.col("size") > 2).join(joined, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        parts = inside.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
        most = parts.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where(F.col("parts") > 1)
        mixed = inside.join(materialize(most.select("bucket", F.col("most.component").alias("major")), "mixed"), "bucket").select("major", "id", "component").distinct()
        late = materialize(self._crossing(materialize(mixed, "crossing")), "links")
        component = connected_components(links.unionByName(late)) if late.limit(1).count() else joined
        told = classes.join(component, "id", "left").where((F.col("copies") > 1) | F.col("component").isNotNull()).select("key", F.coalesce("component", "id").alias("component_id"))
        out = profile.select("id", "n", "key").join(told, "key", "left")
        return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rows: int = 6) -> DataFrame:
    """Near-duplicate groups: id, n_shingles, component_id (smallest id reachable over links), kept.

    Linked are documents whose sets of ``shingle``-word shingles have a Jaccard similarity of ``percent`` / 100
    or more; with fewer words the whole sequence is the one shingle. Null, empty and blank texts have empty sets
    and are linked with nothing. A row without id is kept, with a null component. Rows of one id are one node;
    each of them is returned. Other columns are not read. Every link found is confirmed on the full sets; a pair
    at the threshold is missed with a probability of 1e-5 at most, and less above it.
    """
    found = NearDuplicates(df, id_col, text_col, shingle, percent, rows).groups()
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
