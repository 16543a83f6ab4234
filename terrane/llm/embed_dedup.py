"""Near-duplicate vectors: graphs per shard, every shard searched, cosines verified, components united.

Equal vectors of a label form one class. A label's classes are dealt into shards of bounded size; a task
builds a shard's graph, finds the links within it and stores the graph. The classes then search the graphs
of their label's other shards, in blocks of bounded size. A search returns how many vectors it linked and
one edge to each component of the shard that they lie in, never the pairs themselves.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import materialize, small_batches
from terrane.llm.components import connected_components
from terrane.llm.hnsw import Graph, within

#: The graphs work in single precision; what comes this near to the threshold is verified in double.
SLACK = 1e-4
#: A block of queries is as large as so many shards; a graph is sent once to each block.
BLOCK_SHARDS = 8


class Shard:
    """A graph over the classes of one shard, with what verification and the result need."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, degree: int, beam: int):
        self.ids, self.copies = ids, copies
        self.unit = _unit(vectors)
        self.graph = Graph(self.unit, degree, beam)
        self.root = np.arange(len(ids))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        names = self.ids.astype(str) if self.ids.dtype == object else self.ids
        np.savez(out, ids=names, copies=self.copies.astype(np.int64), unit=self.unit, root=self.root, **self.graph.arrays())
        return out.getvalue()

    @staticmethod
    def loads(data: bytes) -> Shard:
        found = np.load(io.BytesIO(data), allow_pickle=False)
        out = object.__new__(Shard)
        out.ids, out.copies, out.unit, out.root = (found[k] for k in ("ids", "copies", "unit", "root"))
        out.graph = Graph.of_arrays(out.unit, found)
        return out

    def links(self, vectors: np.ndarray, threshold: float, target: float, own: bool = False) -> list[np.ndarray]:
        """Places of the shard's vectors whose cosine reaches the threshold, for every query; ``own``: of the shard's vectors."""
        unit = _unit(vectors)
        out = []
        for q, near in zip(unit, within(self.graph, unit, threshold - SLACK, target=target, own=own)):
            out.append(near[self.unit[near] @ q >= threshold] if len(near) else near)
        return out

    def settle(self, links: list[np.ndarray]) -> None:
        """Components within the shard; the root is the place of the smallest id."""
        rank = np.argsort(np.argsort(self.ids, kind="stable"), kind="stable")
        parent = list(range(len(self.ids)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i, near in enumerate(links):
            for j in near.tolist():
                a, b = find(i), find(j)
                if a != b:
                    a, b = (a, b) if rank[a] < rank[b] else (b, a)
                    parent[b] = a
        self.root = np.array([find(i) for i in range(len(parent))], np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, np.float64)
    scale = np.abs(vectors).max(1, keepdims=True)  # so that no square overflows or vanishes
    vectors = vectors / scale
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _keys(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, key and vector; key (128 bits) is null where the vector or label does not take part."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    infinite = [F.lit(float(x)) for x in ("nan", "inf", "-inf")]
    finite = F.forall("vector", lambda v: F.coalesce(~v.isin(infinite), F.lit(False)))
    fine = F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0)
    key = F.concat_ws(":", F.xxhash64("vector", "label").cast("string"), F.xxhash64(F.lit(7), "label", "vector").cast("string"))
    return rows.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), key))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, shard_size: int = 8192, degree: int = 12, beam: int = 48, target: float = 0.99) -> DataFrame:
    """Near-duplicate groups of vectors: id, n_links, component_id (smallest id reachable over links), kept.

    Linked are vectors of equal label whose cosine, in double precision, is ``threshold`` or more. Vectors that are
    null, empty, zero or hold null or non-finite components, and those with a null label, are linked with nothing;
    vectors of different lengths neither. A row without id counts nowhere and is kept, with a null component; rows
    of one id are one node of the components. Other columns are not read. Every link found is verified; links
    are missed where a search misses them, of which audits against whole shards allow 1 - ``target``; of blocks of
    queries with too few links for an audit all queries are audited.
    """
    kind = df.schema[id_col].dataType.simpleString()
    small_batches(df.sparkSession)
    rows = materialize(_keys(df, id_col, vector_col, label_col), "vectors")
    named = rows.where(F.col("id").isNotNull() & F.col("key").isNotNull())
    classes = named.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.first(F.col("label").cast("string")).alias("label"))
    classes = classes.withColumn("label", F.concat_ws("/", F.size("vector").cast("string"), "label"))
    classes = materialize(classes, "classes")
    totals = classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / shard_size).cast("int").alias("shards"))
    dealt = classes.join(totals, "label").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    dealt = materialize(dealt, "shards")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key").reset_index(drop=True)
        own = Shard(pdf["id"].to_numpy(), pdf["copies"].to_numpy(), vectors := _stack(pdf["vector"]), degree, beam)
        links = own.links(vectors, threshold, target, own=True)
        links = [near[near != i] for i, near in enumerate(links)]
        own.settle(links)
        out = pdf[["label", "shard", "shards", "key", "id"]].copy()
        out["n"] = [int(own.copies[near].sum()) for near in links]
        out["root"] = own.ids[own.root]
        out["index"] = None
        if int(pdf["shards"].iloc[0]) > 1:
            out.loc[len(out)] = [pdf["label"].iloc[0], pdf["shard"].iloc[0], pdf["shards"].iloc[0], None, None, None, None, own.dumps()]
        return out.astype({"id": "object", "n": "Int64", "root": "object"})

    schema = f"label string, shard int, shards int, key string, id {kind}, n bigint, root {kind}, index binary"
    built = materialize(dealt.groupBy("label", "shard").applyInPandas(build, schema), "built")
    counts = built.where(F.col("key").isNotNull()).select("key", "n")
    edges = built.where(F.col("key").isNotNull() & (F.col("id") != F.col("root"))).select(F.col("id").alias("a"), F.col("root").alias("b"))
    graphs = built.where(F.col("index").isNotNull()).select("label", "shard", "shards", "index")
    # searches of the other shards, in blocks of as many queries as some shards have vectors
    parts = F.ceil(F.col("shards") / BLOCK_SHARDS).cast("int")
    blocks = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))
    queries = dealt.where(F.col("shards") > 1).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), parts).cast("int"))
    queries = queries.withColumnRenamed("shard", "own").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where(F.col("shard") != F.col("own"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "id": [], "n": [], "root": []})
        shard = Shard.loads(right["index"].iloc[0])
        n, a, b, k = [], [], [], []
        for key, one, near in zip(left["key"], left["id"], shard.links(_stack(left["vector"]), threshold, target)):
            if not len(near):
                continue
            roots = np.unique(shard.ids[shard.root[near]])
            k += [key] * len(roots)
            a += [one] * len(roots)
            b += roots.tolist()
            n += [int(shard.copies[near].sum())] + [0] * (len(roots) - 1)
        return pd.DataFrame({"key": k, "id": a, "n": n, "root": b})

    found = queries.groupBy("label", "shard", "block").cogroup(blocks.groupBy("label", "shard", "block")).applyInPandas(search, f"key string, id {kind}, n bigint, root {kind}")
    found = materialize(found, "found")
    counts = counts.unionByName(found.select("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    component = connected_components(edges.unionByName(found.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    told = classes.select("key", "id", "copies").join(counts, "key").join(component, "id", "left").select("key", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    told = materialize(told, "told")
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(told, "key", "left")
    component_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))
