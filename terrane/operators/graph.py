"""Graphs as nodes(id) and edges(src, dst). Undirected graphs hold both directions; nodes without edges count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.sources.shared import settled


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def _ends(a: str, b: str) -> list[Column]:
    return [F.col(a).alias("src"), F.col(b).alias("dst")]


def from_adjacency(df: DataFrame) -> Graph:
    """(id, neighbours array) -> graph."""
    return Graph(df.select("id").distinct(), df.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst")).distinct())


def adjacency(g: Graph) -> DataFrame:
    """(id, neighbours array), sorted; empty for nodes without edges."""
    found = g.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    empty = F.array().cast(found.schema["neighbours"].dataType)
    return g.nodes.join(found, "id", "left").select("id", F.coalesce("neighbours", empty).alias("neighbours"))


def from_matrix(cells: DataFrame) -> Graph:
    """Non-zero cells (row, col, value) of a square sparse matrix; rows with an empty cell keep their node."""
    nodes = cells.select(F.col("row").alias("id")).unionByName(cells.select(F.col("col").alias("id"))).distinct().where(F.col("id").isNotNull())
    return Graph(nodes, cells.where(F.col("value") != 0).select(*_ends("row", "col")).distinct())


def to_undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(*_ends("dst", "src"))).distinct()


def similarities_to_graph(nodes: DataFrame, pairs: DataFrame, threshold: float = 0.9) -> Graph:
    """Edges where the value of (a, b, value) is above the threshold."""
    return Graph(nodes, to_undirected(pairs.where((F.col("value") > threshold) & (F.col("a") != F.col("b"))).select(*_ends("a", "b"))))


def distances_to_graph(nodes: DataFrame, pairs: DataFrame, threshold: float = 0.1, loops: bool = True) -> Graph:
    """Edges where the value is below the threshold. The distance of a node to itself is 0, which makes a loop
    unless ``loops`` is off."""
    edges = to_undirected(pairs.where((F.col("value") < threshold) & (F.col("a") != F.col("b"))).select(*_ends("a", "b")))
    if loops and threshold > 0:
        edges = edges.unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    return Graph(nodes, edges)


def label_nodes(g: Graph, labels: DataFrame) -> Graph:
    """Rename by (id, label); nodes of one label fall together."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("new_src")), labels.select(F.col("id").alias("dst"), F.col("label").alias("new_dst"))
    edges = g.edges.join(a, "src").join(b, "dst").select(*_ends("new_src", "new_dst")).distinct()
    return Graph(g.nodes.join(labels, "id").select(F.col("label").alias("id")).distinct(), edges)


def degrees(g: Graph) -> DataFrame:
    return g.nodes.join(g.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def complement(g: Graph) -> Graph:
    """All ordered pairs of different nodes that are no edge; meant for graphs of regions, not of samples."""
    pairs = g.nodes.select(F.col("id").alias("src")).crossJoin(g.nodes.select(F.col("id").alias("dst"))).where(F.col("src") != F.col("dst"))
    return Graph(g.nodes, pairs.join(g.edges, ["src", "dst"], "left_anti"))


def remove_self_loops(g: Graph) -> Graph:
    return Graph(g.nodes, g.edges.where(F.col("src") != F.col("dst")))


def merge_nodes(g: Graph, i, j, new) -> Graph:
    """Nodes i and j become ``new``; the edge between them goes."""
    name = lambda c: F.when(F.col(c).isin(i, j), F.lit(new)).otherwise(F.col(c))
    edges = g.edges.where(~(F.col("src").isin(i, j) & F.col("dst").isin(i, j))).select(name("src").alias("src"), name("dst").alias("dst")).distinct()
    return Graph(g.nodes.select(name("id").alias("id")).distinct(), edges)


def configuration_graph(g: Graph, seed: int = 0) -> DataFrame:
    """A graph of the same degrees: every edge's two ends are shuffled by their hash and paired anew; (src, dst)
    one way. Pairs are made within 256 ranges of the hash, what is left over is paired across them."""
    one = g.edges.where(F.col("src") <= F.col("dst"))
    ends = one.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.md5(F.concat_ws(":", "src", "dst", F.lit("a"), F.lit(seed))).alias("h")), F.struct(F.col("dst").alias("node"), F.md5(F.concat_ws(":", "src", "dst", F.lit("b"), F.lit(seed))).alias("h")))).alias("e")).select("e.node", "e.h")
    ends = ends.withColumn("range", F.substring("h", 1, 2))
    order = W.partitionBy("range").orderBy("h", "node")
    placed = ends.withColumn("n", F.row_number().over(order) - 1).withColumn("size", F.count(F.lit(1)).over(W.partitionBy("range")))
    single = (F.col("n") == F.col("size") - 1) & (F.col("size") % 2 == 1)
    inner = placed.where(~single).groupBy("range", F.floor(F.col("n") / 2).alias("pair")).agg(F.min_by("node", "n").alias("src"), F.max_by("node", "n").alias("dst")).select("src", "dst")
    rest = placed.where(single).withColumn("n", F.row_number().over(W.orderBy("range")) - 1)  # 256 rows at most
    outer = rest.groupBy(F.floor(F.col("n") / 2).alias("pair")).agg(F.min_by("node", "n").alias("src"), F.max_by("node", "n").alias("dst")).select("src", "dst")
    return inner.unionByName(outer)


def connected_components(g: Graph) -> DataFrame:
    """(id, component): the smallest node reachable. Labels go to neighbours and then jump along themselves, so
    the rounds grow with the logarithm of a path, not its length; every round is written down."""
    edges = settled(to_undirected(g.edges))
    now = settled(g.nodes.select("id", F.col("id").alias("component")))
    while True:
        near = edges.join(now.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        step = now.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("c", "component")).alias("new"))
        jump = step.alias("s").join(step.select(F.col("id").alias("new"), F.col("new").alias("further")), "new")
        then = settled(jump.select(F.col("s.id").alias("id"), F.least("new", "further").alias("component"), F.col("s.component").alias("old")))
        changed = then.where(F.col("component") != F.col("old")).limit(1).count()
        now = then.select("id", "component")
        if not changed:
            return now


# ---- graphs of regions: a few dozen nodes, as dictionaries of sets on the driver


def as_sets(g: Graph, limit: int = 5_000) -> dict:
    """The graph as {node: neighbours}, in the order of the nodes; for graphs of at most ``limit`` nodes."""
    rows = adjacency(g).orderBy("id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} nodes")
    return {r["id"]: set(r["neighbours"]) for r in rows}


def max_cliques(graph: dict) -> list[set]:
    """All maximal cliques, largest first; loops do not count. Branches only where no pivot's neighbour serves."""
    graph = {k: v - {k} for k, v in graph.items()}
    out, stack = [], [(frozenset(), set(graph), set())]
    while stack:
        clique, open_, closed = stack.pop()
        if not open_ and not closed:
            out.append(set(clique))
            continue
        pivot = max(sorted(open_ | closed), key=lambda u: len(graph[u] & open_))
        for v in sorted(open_ - graph[pivot]):
            stack.append((clique | {v}, open_ & graph[v], closed & graph[v]))
            open_ = open_ - {v}
            closed = closed | {v}
    return sorted((c for c in out if c), key=lambda c: (-len(c), sorted(c)))


def independent_sets(graph: dict) -> list[set]:
    """All maximal sets without an edge."""
    return max_cliques({k: set(graph) - v - {k} for k, v in graph.items()})


def greedy_coloring(graph: dict, order: str = "given") -> dict:
    """The first free colour for each node, in the given order, by ``degree`` or ``largest_first``."""
    nodes = list(graph)
    if order == "degree":
        nodes.sort(key=lambda v: len(graph[v]))
    elif order == "largest_first":
        nodes.sort(key=lambda v: -len(graph[v]))
    elif order != "given":
        raise ValueError("order must be given, degree or largest_first")
    color: dict = {}
    for v in nodes:
        taken = {color[u] for u in graph[v] if u in color}
        color[v] = next(c for c in range(len(graph) + 1) if c not in taken)
    return color


def small_components(graph: dict) -> list[list]:
    """Components of an undirected graph, each in the order of the nodes, largest first."""
    seen: set = set()
    out = []
    for start in graph:
        if start in seen:
            continue
        seen.add(start)
        todo, own = [start], []
        while todo:
            v = todo.pop()
            own.append(v)
            for u in graph[v] - seen:
                seen.add(u)
                todo.append(u)
        out.append([v for v in graph if v in set(own)])
    return sorted(out, key=len, reverse=True)
