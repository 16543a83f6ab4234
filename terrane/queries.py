"""Registered queries of the engine and the DuckDB SQL that checks them.

Every query is (spark, sf_dir) -> DataFrame. Those on regions use the two first components of ``embeddings`` as x
and y and bins with fixed edges, so that SQL can do the same from the raw table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import boxes, rules
from terrane.operators import encode, geometry, graph, joins, metrics, plotdata, regions, scores
from terrane.operators.embedding import Grid, binned, density, embedding_scale, grid_ticks, neighbour_distances
from terrane.sources.ingest import ingest, sample_exact, to_wide
from terrane.sources.tables import embedded, small_table, table

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

#: Fixed bin edges of the first two components.
EDGES = {0: [-0.17, -0.06, 0.03, 0.15], 1: [-0.18, -0.07, 0.02, 0.13]}
#: Fixed rectangular regions: (ra_id, axis, lower, upper).
BANDS = [(5 * v + i, v, round(-0.30 + 0.10 * i, 2), round(-0.10 + 0.10 * i, 2)) for v in (0, 1) for i in range(5)]


def query(sql: str | None = None):
    def register(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return register


def _round(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---- ingest


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), "p_size", "p_retailprice", "p_brand")


@query("""
SELECT 0::INT AS var_id, 'p_size' AS name, 'continuous' AS kind, NULL::VARCHAR AS categories
UNION ALL SELECT 1, 'p_retailprice', 'continuous', NULL
UNION ALL SELECT 2, 'p_brand', 'discrete', string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) FROM part""")
def ingest_variables(spark, sf_dir):
    v = ingest(_parts(spark, sf_dir), "sample_id").variables
    return v.select("var_id", "name", "kind", F.array_join("categories", ",").alias("categories"))


@query("""
SELECT p_partkey AS sample_id, p_brand AS level, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS code FROM part""")
def ingest_codes(spark, sf_dir):
    return ingest(_parts(spark, sf_dir), "sample_id").levels.select("sample_id", "level", "code")


@query("SELECT p_partkey AS sample_id, p_size::DOUBLE AS p_size, p_retailprice, p_brand FROM part")
def ingest_roundtrip(spark, sf_dir):
    df = _parts(spark, sf_dir)
    return to_wide(ingest(df, "sample_id"), df)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat(o_orderkey::VARCHAR, ':7')), o_orderkey LIMIT 500")
def sample_exact_rows(spark, sf_dir):
    return sample_exact(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 500, "o_orderkey", 7)


# ---- encodings


@query("""
SELECT * FROM (VALUES ('l_quantity', 1), ('l_tax', 1), ('l_linestatus', 1)) v(name, keep)""")
def filter_constant(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_linestatus", F.lit(3.0).alias("same"), F.when(F.col("l_orderkey") % 2 == 0, 5.0).otherwise(float("nan")).alias("same_or_nan"))
    kept = encode.informative_columns(df, "l_orderkey")
    return small_table(spark, [(c, 1) for c in kept], "name string, keep int")


@query("SELECT ord::INT AS ord, count(*)::BIGINT AS n FROM (SELECT (p_size >= 10.5)::INT + (p_size >= 20.5)::INT + (p_size >= 30.5)::INT + (p_size >= 40.5)::INT AS ord FROM part) GROUP BY 1")
def discretize_edges(spark, sf_dir):
    data = ingest(_parts(spark, sf_dir).select("sample_id", "p_size"), "sample_id")
    found = encode.discretize(data.numbers, data.variables, {0: [10.5, 20.5, 30.5, 40.5]})
    return found.membership.groupBy((F.col("ind_id") % encode.IND).cast("int").alias("ord")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE pts AS (SELECT p_size::DOUBLE AS v, count(*)::DOUBLE AS n FROM part GROUP BY 1),
b AS (SELECT min(v) AS lo, max(v) AS hi, sum(v * n) / sum(n) AS mean FROM pts),
t AS (SELECT 1e-4::DOUBLE * sum(n * (v - mean) * (v - mean)) / sum(n) AS tol FROM pts, b GROUP BY mean),
it(i, c1, c2, c3, c4, c5, shift) AS (
 SELECT 0, lo + (hi - lo) * 0.1::DOUBLE, lo + (hi - lo) * 0.3::DOUBLE, lo + (hi - lo) * 0.5::DOUBLE, lo + (hi - lo) * 0.7::DOUBLE, lo + (hi - lo) * 0.9::DOUBLE, 1e300::DOUBLE FROM b
 UNION ALL
 SELECT i + 1, n1, n2, n3, n4, n5, (n1-c1)*(n1-c1) + (n2-c2)*(n2-c2) + (n3-c3)*(n3-c3) + (n4-c4)*(n4-c4) + (n5-c5)*(n5-c5) FROM (
  SELECT i, c1, c2, c3, c4, c5,
   sum(v*n) FILTER (WHERE v < (c1+c2)/2) / sum(n) FILTER (WHERE v < (c1+c2)/2) AS n1,
   sum(v*n) FILTER (WHERE v >= (c1+c2)/2 AND v < (c2+c3)/2) / sum(n) FILTER (WHERE v >= (c1+c2)/2 AND v < (c2+c3)/2) AS n2,
   sum(v*n) FILTER (WHERE v >= (c2+c3)/2 AND v < (c3+c4)/2) / sum(n) FILTER (WHERE v >= (c2+c3)/2 AND v < (c3+c4)/2) AS n3,
   sum(v*n) FILTER (WHERE v >= (c3+c4)/2 AND v < (c4+c5)/2) / sum(n) FILTER (WHERE v >= (c3+c4)/2 AND v < (c4+c5)/2) AS n4,
   sum(v*n) FILTER (WHERE v >= (c4+c5)/2) / sum(n) FILTER (WHERE v >= (c4+c5)/2) AS n5
  FROM it, pts WHERE i < 60 AND shift > (SELECT tol FROM t) GROUP BY i, c1, c2, c3, c4, c5)
),
f AS (SELECT * FROM it ORDER BY i DESC LIMIT 1)
SELECT (v >= (c1+c2)/2)::INT + (v >= (c2+c3)/2)::INT + (v >= (c3+c4)/2)::INT + (v >= (c4+c5)/2)::INT AS ord, sum(n)::BIGINT AS n FROM pts, f GROUP BY 1""")
def discretize_kmeans(spark, sf_dir):
    data = ingest(_parts(spark, sf_dir).select("sample_id", "p_size"), "sample_id")
    found = encode.discretize(data.numbers, data.variables, encode.bin_edges(data.numbers, 5))
    return found.membership.groupBy((F.col("ind_id") % encode.IND).cast("int").alias("ord")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'eq' AS kind, '3.0' AS val, count(*)::BIGINT AS n FROM part")
def discretize_const(spark, sf_dir):
    data = ingest(_parts(spark, sf_dir).select("sample_id", F.lit(3.0).alias("three")), "sample_id")
    found = encode.discretize(data.numbers, data.variables, encode.bin_edges(data.numbers, 5))
    return found.membership.join(found.indicators, "ind_id").groupBy(F.col("rule.kind").alias("kind"), F.col("rule.vals")[0].alias("val")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS level, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def one_hot(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_orderpriority")
    data = ingest(df, "sample_id")
    found = encode.one_hot(data.levels, data.variables)
    return found.membership.join(found.indicators, "ind_id").groupBy(F.col("rule.vals")[0].alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'o_orderstatus' AS var, o_orderstatus AS level, NULL::DOUBLE AS lower, count(*)::BIGINT AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_totalprice', NULL, CASE WHEN o_totalprice >= 200000 THEN 200000 ELSE -1e308 END::DOUBLE, count(*) FROM orders GROUP BY 3""")
def expand_indicators(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_orderstatus", "o_totalprice")
    found = encode.expand(ingest(df, "sample_id", ordered={"o_orderstatus": ["F", "O", "P", "never"]}), edges={1: [200000.0]})
    rows = found.membership.join(found.indicators, "ind_id").groupBy("var", F.col("rule.vals")[0].alias("level"), F.greatest("rule.lower", F.when(F.col("rule.lower").isNotNull(), -1e308)).alias("lower"))
    return rows.agg(F.count(F.lit(1)).alias("n"))


# ---- rules

#: Fixed pairs of rules: intervals that touch, overlap, contain and part; values alone and in sets.
_RULES = [
    ("i", 2, 7.5, None), ("i", 7.5, 11, None), ("i", 11, 18, None), ("i", 2, 8, None), ("i", 6.25, 12, None), ("i", 10, 19, None), ("i", 3, 5, None), ("i", "-inf", 9, None), ("i", 14, "inf", None), ("i", 4.5, 5.25, None), ("i", -20, "inf", None), ("i", "-inf", 21, None),
    ("v", None, None, "4"), ("v", None, None, "9"), ("v", None, None, "1,6"), ("v", None, None, "3,8"), ("v", None, None, "1,6,7"), ("v", None, None, "6,7,9"), ("v", None, None, "6,7"), ("v", None, None, "0,2,5"),
]

def _rule_values() -> str:
    q = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"({n}, {q('interval' if k == 'i' else 'eq' if ',' not in v else 'oneof')}, {q(lo)}, {q(up)}, {q(v)})" for n, (k, lo, up, v) in enumerate(_RULES))


_RULE_SQL = f"""
WITH r AS (SELECT id::INT AS id, kind, lo::DOUBLE AS lo, up::DOUBLE AS up, string_split(v, ',') AS v FROM (VALUES {_rule_values()}) t(id, kind, lo, up, v)),
p AS (SELECT a.id AS a, b.id AS b, a.kind AS ka, b.kind AS kb, a.lo AS la, a.up AS ua, b.lo AS lb, b.up AS ub, a.v AS va, b.v AS vb,
 coalesce(CASE WHEN a.kind = 'interval' AND b.kind = 'interval' THEN a.lo <= b.up AND b.lo <= a.up ELSE a.kind <> 'interval' AND b.kind <> 'interval' END, false) AS can FROM r a, r b)
"""


def _rule_rows(spark: SparkSession) -> DataFrame:
    rows = [(n, None if lo is None else float(lo), None if up is None else float(up), None if v is None else v.split(",")) for n, (_, lo, up, v) in enumerate(_RULES)]
    df = small_table(spark, rows, "id int, lo double, up double, v array<string>")
    name = F.lit("x")
    rule = F.when(F.col("v").isNull(), rules.interval(F.col("lo"), F.col("up"), name)).otherwise(rules.values(F.col("v"), name))
    return df.select("id", rule.cast(rules.RULE).alias("rule"))


def _rule_pairs(spark: SparkSession) -> DataFrame:
    r = _rule_rows(spark)
    return r.select(F.col("id").alias("a"), F.col("rule").alias("ra")).crossJoin(r.select(F.col("id").alias("b"), F.col("rule").alias("rb")))


@query(_RULE_SQL + "SELECT a, b, can FROM p")
def rule_can_merge(spark, sf_dir):
    return _rule_pairs(spark).select("a", "b", rules.can_merge(F.col("ra"), F.col("rb")).alias("can"))


@query(_RULE_SQL + """
SELECT a, b, CASE WHEN ka = 'interval' THEN least(la, lb) END AS lower, CASE WHEN ka = 'interval' THEN greatest(ua, ub) END AS upper,
 CASE WHEN ka <> 'interval' THEN array_to_string(list_sort(list_distinct(list_concat(va, vb))), ',') END AS vals FROM p WHERE can""")
def rule_merge(spark, sf_dir):
    both = _rule_pairs(spark).select("a", "b", rules.merge(F.col("ra"), F.col("rb")).alias("m")).where(F.col("m").isNotNull())
    return both.select("a", "b", "m.lower", "m.upper", F.array_join("m.vals", ",").alias("vals"))


@query(_RULE_SQL + """
SELECT a, b, coalesce(CASE WHEN ka = 'interval' THEN kb = 'interval' AND la <= lb AND ub <= ua
 WHEN ka = 'eq' THEN kb = 'eq' AND va = vb ELSE kb <> 'interval' AND list_has_all(va, vb) END, false) AS inside FROM p""")
def rule_contains(spark, sf_dir):
    return _rule_pairs(spark).select("a", "b", rules.contains(F.col("ra"), F.col("rb")).alias("inside"))


@query(_RULE_SQL + """
SELECT id, CASE WHEN kind = 'eq' THEN 'x = ' || v[1] WHEN kind = 'oneof' THEN 'x in {' || array_to_string(list_sort(v), ', ') || '}'
 WHEN isinf(up) THEN printf('x > %.2f', lo) ELSE CASE WHEN isinf(lo) THEN '' ELSE printf('%.2f < ', lo) END || printf('x < %.2f', up) END AS text FROM r""")
def rule_text(spark, sf_dir):
    return _rule_rows(spark).select("id", rules.text(F.col("rule")).alias("text"))


# ---- embedding and regions

_E = """e AS (SELECT vec_id AS sample_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::VARCHAR AS label FROM embeddings)"""
_SCALE = _E + """,
nn AS (SELECT a.sample_id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d, row_number() OVER (PARTITION BY a.sample_id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS rn FROM e a JOIN e b ON a.sample_id <> b.sample_id),
s AS (SELECT median(d) AS scale FROM nn WHERE rn = (SELECT floor(sqrt(count(*)))::BIGINT FROM e))"""
_GRID = _SCALE + """,
r AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, (SELECT scale FROM s) AS h FROM e),
q AS (SELECT *, greatest(0.05::DOUBLE * (bx - ax), 3 * h) AS ox, greatest(0.05::DOUBLE * (by_ - ay), 3 * h) AS oy FROM r),
g AS (SELECT ax - ox AS x0, ay - oy AS y0, (bx - ax + 2 * ox) / 99 AS dx, (by_ - ay + 2 * oy) / 99 AS dy, h FROM q)"""
_BIN = lambda v, c: f"SELECT sample_id, {v * encode.IND}::BIGINT + " + " + ".join(f"({c} >= {x}::DOUBLE)::INT" for x in EDGES[v]) + " AS ind_id FROM e"
_MEMBERS = f"m AS ({_BIN(0, 'x')} UNION ALL {_BIN(1, 'y')})"
_BINNED = _GRID + f""",
{_MEMBERS},
pl AS (SELECT sample_id, least(floor((x - x0) / dx), 98)::INT AS gx, least(floor((y - y0) / dy), 98)::INT AS gy, (x - x0) / dx AS u, (y - y0) / dy AS v FROM e, g),
pc AS (SELECT sample_id, gx, gy, u - gx AS fx, v - gy AS fy FROM pl),
c AS (SELECT ind_id, gx, gy, (1 - fx) * (1 - fy) AS w FROM pc JOIN m USING (sample_id) UNION ALL SELECT ind_id, gx + 1, gy, fx * (1 - fy) FROM pc JOIN m USING (sample_id)
 UNION ALL SELECT ind_id, gx, gy + 1, (1 - fx) * fy FROM pc JOIN m USING (sample_id) UNION ALL SELECT ind_id, gx + 1, gy + 1, fx * fy FROM pc JOIN m USING (sample_id)),
w AS MATERIALIZED (SELECT ind_id, gx, gy, sum(w) AS w FROM c GROUP BY ALL HAVING sum(w) > 0)"""
_SMOOTH = _BINNED + """,
t AS (SELECT i::INT AS i FROM range(100) t(i)),
sx AS (SELECT ind_id, i AS gx, gy, sum(w * exp(-0.5::DOUBLE * ((i - gx) * dx / h) * ((i - gx) * dx / h))) AS w FROM w, t, g GROUP BY ALL),
z AS MATERIALIZED (SELECT ind_id, gx, i AS gy, sum(w * exp(-0.5::DOUBLE * ((i - gy) * dy / h) * ((i - gy) * dy / h))) AS z FROM sx, t, g GROUP BY ALL),
zm AS MATERIALIZED (SELECT ind_id, gx, gy, z, z / sum(z) OVER (PARTITION BY ind_id) AS z_sum, z / max(z) OVER (PARTITION BY ind_id) AS z_max FROM z)"""
_INSIDE = _SMOOTH + """,
cl AS MATERIALIZED (SELECT a.ind_id, a.gx, a.gy, a.z_max AS z00, b.z_max AS z10, c2.z_max AS z01, d.z_max AS z11 FROM zm a JOIN zm b ON a.ind_id = b.ind_id AND b.gx = a.gx + 1 AND b.gy = a.gy
 JOIN zm c2 ON a.ind_id = c2.ind_id AND c2.gx = a.gx AND c2.gy = a.gy + 1 JOIN zm d ON a.ind_id = d.ind_id AND d.gx = a.gx + 1 AND d.gy = a.gy + 1),
k AS MATERIALIZED (SELECT ind_id, sample_id, fx, fy, z00, z10, z01, z11, (z00 > 0.25)::INT + (z10 > 0.25)::INT + (z01 > 0.25)::INT + (z11 > 0.25)::INT AS n,
 z00 > 0.25 AS a, z10 > 0.25 AS b, z01 > 0.25 AS c, z11 > 0.25 AS d,
 fx / ((z00 - 0.25::DOUBLE) / (z00 - z10)) + fy / ((z00 - 0.25::DOUBLE) / (z00 - z01)) AS ca,
 (1 - fx) / ((z10 - 0.25::DOUBLE) / (z10 - z00)) + fy / ((z10 - 0.25::DOUBLE) / (z10 - z11)) AS cb,
 fx / ((z01 - 0.25::DOUBLE) / (z01 - z11)) + (1 - fy) / ((z01 - 0.25::DOUBLE) / (z01 - z00)) AS cc,
 (1 - fx) / ((z11 - 0.25::DOUBLE) / (z11 - z01)) + (1 - fy) / ((z11 - 0.25::DOUBLE) / (z11 - z10)) AS cd
 FROM pc JOIN cl USING (gx, gy)),
i AS MATERIALIZED (SELECT ind_id, sample_id FROM k WHERE CASE WHEN n = 0 THEN false WHEN n = 4 THEN true
 WHEN n = 1 THEN CASE WHEN a THEN ca <= 1 WHEN b THEN cb <= 1 WHEN c THEN cc <= 1 ELSE cd <= 1 END
 WHEN n = 3 THEN CASE WHEN NOT a THEN ca >= 1 WHEN NOT b THEN cb >= 1 WHEN NOT c THEN cc >= 1 ELSE cd >= 1 END
 WHEN a AND c THEN fx <= (z00 - 0.25::DOUBLE) / (z00 - z10) + ((z01 - 0.25::DOUBLE) / (z01 - z11) - (z00 - 0.25::DOUBLE) / (z00 - z10)) * fy
 WHEN b AND d THEN 1 - fx <= (z10 - 0.25::DOUBLE) / (z10 - z00) + ((z11 - 0.25::DOUBLE) / (z11 - z01) - (z10 - 0.25::DOUBLE) / (z10 - z00)) * fy
 WHEN a AND b THEN fy <= (z00 - 0.25::DOUBLE) / (z00 - z01) + ((z10 - 0.25::DOUBLE) / (z10 - z11) - (z00 - 0.25::DOUBLE) / (z00 - z01)) * fx
 WHEN c AND d THEN 1 - fy <= (z01 - 0.25::DOUBLE) / (z01 - z00) + ((z11 - 0.25::DOUBLE) / (z11 - z10) - (z01 - 0.25::DOUBLE) / (z01 - z00)) * fx
 WHEN a AND d THEN CASE WHEN (z00 + z10 + z01 + z11) / 4 > 0.25 THEN cb >= 1 AND cc >= 1 ELSE ca <= 1 OR cd <= 1 END
 ELSE CASE WHEN (z00 + z10 + z01 + z11) / 4 > 0.25 THEN ca >= 1 AND cd >= 1 ELSE cb <= 1 OR cc <= 1 END END)"""


def _samples(spark, sf_dir) -> DataFrame:
    return embedded(spark, sf_dir).select("sample_id", "x", "y")


def _binned_members(spark, sf_dir) -> encode.Indicators:
    data = ingest(embedded(spark, sf_dir).select("sample_id", "e0", "e1"), "sample_id")
    return encode.discretize(data.numbers, data.variables, EDGES)


def _frame(spark, sf_dir):
    samples = _samples(spark, sf_dir).persist()
    scale = embedding_scale(samples)
    return samples, scale, Grid.around(samples, scale), _binned_members(spark, sf_dir)


def _cells(spark, sf_dir):
    samples, scale, grid, ind = _frame(spark, sf_dir)
    return samples, grid, ind, regions.region_cells(binned(samples, grid, ind.membership), grid, scale)


def _inside(spark, sf_dir):
    samples, grid, ind, cells = _cells(spark, sf_dir)
    return samples, ind, regions.samples_inside(samples, cells, grid)


@query(f"WITH {_E}, nn AS (SELECT a.sample_id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d, row_number() OVER (PARTITION BY a.sample_id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS rn FROM e a JOIN e b ON a.sample_id <> b.sample_id) SELECT sample_id, round(d, 6) AS distance FROM nn WHERE rn = 10")
def kth_neighbor(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    return neighbour_distances(samples, 10, samples.count()).select("sample_id", _round("distance").alias("distance"))


@query(f"WITH {_SCALE} SELECT round(scale, 6) AS scale, round(scale * 0.5::DOUBLE, 6) AS half FROM s")
def embedding_scale_value(spark, sf_dir):
    samples = _samples(spark, sf_dir).persist()
    return small_table(spark, [(embedding_scale(samples), embedding_scale(samples, 0.5))], "scale double, half double").select(_round("scale").alias("scale"), _round("half").alias("half"))


@query(f"WITH {_GRID} SELECT i::INT AS g, round(x0 + i * dx, 6) AS x, round(y0 + i * dy, 6) AS y FROM g, range(100) t(i)")
def density_grid(spark, sf_dir):
    samples = _samples(spark, sf_dir).persist()
    return grid_ticks(samples, Grid.around(samples, embedding_scale(samples))).select("g", _round("x").alias("x"), _round("y").alias("y"))


@query(f"WITH {_BINNED} SELECT ind_id, gx, gy, round(w, 6) AS w FROM w")
def kde_binned(spark, sf_dir):
    """All weights, however small."""
    samples, _, grid, ind = _frame(spark, sf_dir)
    return binned(samples, grid, ind.membership).select("ind_id", "gx", "gy", _round("w").alias("w"))


@query(f"WITH {_SMOOTH} SELECT ind_id, gx, gy, round(z, 5) AS z FROM z")
def kde_smoothed(spark, sf_dir):
    """Densities at all grid points."""
    samples, scale, grid, ind = _frame(spark, sf_dir)
    return density(binned(samples, grid, ind.membership), grid, scale).select("ind_id", "gx", "gy", _round("z", 5).alias("z"))


@query(f"WITH {_SMOOTH} SELECT ind_id, gx, gy, round(z_sum, 7) AS z_sum, round(z_max, 5) AS z_max FROM zm")
def kde_scaled(spark, sf_dir):
    """Scaled densities at all grid points."""
    samples, scale, grid, ind = _frame(spark, sf_dir)
    return density(binned(samples, grid, ind.membership), grid, scale).select("ind_id", "gx", "gy", _round("z_sum", 7).alias("z_sum"), _round("z_max", 5).alias("z_max"))


#: All kernels but the box, whose edge falls on grid points; each as SQL of the distance in bandwidths over its width.
_SMOOTH_KERNELS = {
    "gaussian": "exp(-0.5::DOUBLE * d * d)",
    "exponential": "exp(-d * sqrt(2))",
    "tri": "greatest(1 - d / sqrt(6), 0)",
    "epa": "greatest(1 - d * d / 5, 0)",
    "biweight": "greatest(1 - d * d / 7, 0) ** 2",
    "triweight": "greatest(1 - d * d / 9, 0) ** 3",
    "tricube": "greatest(1 - (d / sqrt(243 / 35)) ** 3, 0) ** 3",
    "cosine": "cos(least(d * sqrt(1 - 8 / (pi() * pi())), 1) * pi() / 2)",
}
_KERNELS = (
    _BINNED
    + ", t AS (SELECT i::INT AS i FROM range(100) t(i)), far AS (SELECT p.i AS di, q.i AS dj, sqrt(p.i * dx * p.i * dx + q.i * dy * q.i * dy) / h AS d FROM t p, t q, g)"
    + ", k AS MATERIALIZED (SELECT di, dj, " + ", ".join(f"{sql} AS {name}" for name, sql in _SMOOTH_KERNELS.items()) + " FROM far)"
    + ", z AS MATERIALIZED (SELECT ind_id, p.i AS gx, q.i AS gy, " + ", ".join(f"sum(w * {name}) AS {name}" for name in _SMOOTH_KERNELS)
    + " FROM w, t p, t q, k WHERE k.di = abs(p.i - w.gx) AND k.dj = abs(q.i - w.gy) GROUP BY ALL)"
)


@query(f"WITH {_KERNELS} SELECT kernel, ind_id, gx, gy, round(z, 4) AS z FROM (UNPIVOT z ON {', '.join(_SMOOTH_KERNELS)} INTO NAME kernel VALUE z)")
def kde_kernels(spark, sf_dir):
    """Densities with all smooth kernels at all grid points."""
    samples, scale, grid, ind = _frame(spark, sf_dir)
    bins = binned(samples, grid, ind.membership).persist()
    out = None
    for kernel in _SMOOTH_KERNELS:
        own = density(bins, grid, scale, kernel).select(F.lit(kernel).alias("kernel"), "ind_id", "gx", "gy", _round("z", 4).alias("z"))
        out = own if out is None else out.unionByName(own)
    return out


@query()
def kde_box_kernel(spark, sf_dir):
    """Grid points above the level with the box kernel, whose edge falls on grid points."""
    samples, scale, grid, ind = _frame(spark, sf_dir)
    rows = density(binned(samples, grid, ind.membership), grid, scale, "box")
    return rows.where("z_max > 0.25").groupBy("ind_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_INSIDE} SELECT ind_id, sample_id FROM i")
def region_membership_kde(spark, sf_dir):
    return _inside(spark, sf_dir)[2].select("ind_id", "sample_id")


@query(f"WITH {_INSIDE} SELECT i.ind_id, count(*)::BIGINT AS n, round(avg((m.sample_id IS NOT NULL)::INT), 6) AS purity FROM i LEFT JOIN m ON i.ind_id = m.ind_id AND i.sample_id = m.sample_id GROUP BY 1")
def region_purity(spark, sf_dir):
    _, ind, inside = _inside(spark, sf_dir)
    rows = metrics.purity(inside.select(F.col("ind_id").alias("ra_id"), "sample_id"), ind.membership.withColumnRenamed("ind_id", "ra_id"))
    return rows.select(F.col("ra_id").alias("ind_id"), "n", _round("purity").alias("purity"))


@query(f"WITH {_INSIDE} SELECT DISTINCT ind_id // {encode.IND} AS grp, sample_id FROM i WHERE ind_id % {encode.IND} IN (0, 1, 2)")
def region_union(spark, sf_dir):
    _, ind, inside = _inside(spark, sf_dir)
    groups = ind.indicators.where("ord <= 2").select(F.col("var_id").cast("long").alias("group"), "ind_id")
    return regions.merge_regions(inside, groups).select(F.col("group").alias("grp"), "sample_id")


@query(f"WITH {_INSIDE} SELECT ind_id // {encode.IND} AS grp, sample_id FROM i WHERE ind_id % {encode.IND} IN (1, 2) GROUP BY 1, 2 HAVING count(DISTINCT ind_id) = 2")
def region_intersection(spark, sf_dir):
    _, ind, inside = _inside(spark, sf_dir)
    groups = ind.indicators.where("ord IN (1, 2)").select(F.col("var_id").cast("long").alias("group"), "ind_id")
    return regions.merge_regions(inside, groups, "intersection").select(F.col("group").alias("grp"), "sample_id")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS x0, l_discount * 10 AS y0, l_tax * 10 AS x1, l_quantity / 20 AS y1, l_discount * 20 AS x2, l_tax * 20 AS y2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(sqrt((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)), sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)), sqrt((x2-x0)*(x2-x0)+(y2-y0)*(y2-y0))), 6) AS edge
FROM t WHERE greatest(sqrt((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)), sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)), sqrt((x2-x0)*(x2-x0)+(y2-y0)*(y2-y0))) < 2.03""")
def rangeset_edge_filter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("x0"), (F.col("l_discount") * 10).alias("y0"), (F.col("l_tax") * 10).alias("x1"), (F.col("l_quantity") / 20).alias("y1"), (F.col("l_discount") * 20).alias("x2"), (F.col("l_tax") * 20).alias("y2"))
    edge = regions.max_edge(*[F.col(f"{a}{i}") for i in range(3) for a in "xy"])
    return t.withColumn("edge", edge).where("edge < 2.03").select("l_orderkey", "l_linenumber", _round("edge").alias("edge"))


@query()
def rangeset_region(spark, sf_dir):
    samples, scale, _, ind = _frame(spark, sf_dir)
    triangles = regions.triangulated(ind.membership.join(samples, "sample_id").select("ind_id", "x", "y"), 0.5 * scale)
    return regions.inside_triangles(samples, triangles, scale).groupBy("ind_id").agg(F.count_distinct("sample_id").alias("n"), F.count_distinct("part_id").alias("parts"))


# ---- metrics and scores, on fixed bands

_BANDS = ", ".join(f"({r}, {v}, {lo}::DOUBLE, {hi}::DOUBLE)" for r, v, lo, hi in BANDS)
_REGIONS = f"""{_E},
b AS (SELECT ra::INT AS ra_id, v::INT AS var_id, lo, hi FROM (VALUES {_BANDS}) t(ra, v, lo, hi)),
inside AS (SELECT ra_id, var_id, sample_id FROM e, b WHERE CASE WHEN var_id = 0 THEN x ELSE y END >= lo AND CASE WHEN var_id = 0 THEN x ELSE y END < hi),
members AS (SELECT ra_id, sample_id FROM e, b WHERE CASE WHEN var_id = 0 THEN x ELSE y END >= lo + 0.05::DOUBLE AND CASE WHEN var_id = 0 THEN x ELSE y END < hi + 0.05::DOUBLE),
n AS (SELECT ra_id, count(*) AS n FROM inside GROUP BY 1),
sh AS (SELECT p.ra_id AS a, q.ra_id AS b, count(*) AS c FROM inside p JOIN inside q ON p.sample_id = q.sample_id AND p.ra_id < q.ra_id GROUP BY ALL),
pr AS (SELECT p.ra_id AS a, q.ra_id AS b, p.n AS n_a, q.n AS n_b, coalesce(c, 0) AS c FROM n p JOIN n q ON p.ra_id < q.ra_id LEFT JOIN sh ON sh.a = p.ra_id AND sh.b = q.ra_id),
pu AS (SELECT i.ra_id, avg((m.sample_id IS NOT NULL)::INT) AS purity, count(*) AS n FROM inside i LEFT JOIN members m ON i.ra_id = m.ra_id AND i.sample_id = m.sample_id GROUP BY 1),
pa AS (SELECT var_id AS panel, ra_id, var_id FROM b UNION ALL SELECT 2, ra_id, var_id FROM b WHERE ra_id IN (0, 2, 4, 6, 8) UNION ALL SELECT 3, ra_id, var_id FROM b WHERE ra_id IN (1, 7))"""


def _scene(spark, sf_dir) -> tuple[scores.Scene, DataFrame]:
    e = embedded(spark, sf_dir).select("sample_id", "x", "y")
    bands = small_table(spark, BANDS, "ra_id int, var_id int, lo double, hi double")

    def within(shift: float) -> DataFrame:
        hit = [F.when((F.col("xy"[v]) >= lo + shift) & (F.col("xy"[v]) < hi + shift), F.lit(r)) for r, v, lo, hi in BANDS]
        return e.select("sample_id", F.explode(F.array_compact(F.array(*hit))).alias("ra_id")).select("ra_id", "sample_id")

    panels = [(v, r) for r, v, _, _ in BANDS] + [(2, r) for r in (0, 2, 4, 6, 8)] + [(3, r) for r in (1, 7)]
    scene = scores.Scene(bands.select("ra_id", "var_id"), within(0.0), within(0.05), e.count())
    return scene, small_table(spark, panels, "panel int, ra_id int")


def _pair_query(metric):
    def run(spark, sf_dir):
        return metrics.pairs(_scene(spark, sf_dir)[0].inside).select("a", "b", _round(metric()).alias("value"))

    return run


for _name, _metric, _sql in (
    ("shared_pct_max", metrics.max_shared_pct, "c / least(n_a, n_b)"),
    ("shared_pct_min", metrics.min_shared_pct, "c / greatest(n_a, n_b)"),
    ("jaccard", metrics.jaccard, "c / (n_a + n_b - c + 1e-8::DOUBLE)"),
):
    _QUERIES[_name] = _pair_query(_metric)
    _SQL[_name] = f"WITH {_REGIONS} SELECT a, b, round({_sql}, 6) AS value FROM pr"


@query(f"WITH {_REGIONS} SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS pos, round(1 - c / (n_a + n_b - c + 1e-8::DOUBLE), 6) AS value FROM pr")
def pair_condensed(spark, sf_dir):
    """The condensed distance vector: positions in the upper triangle, row by row."""
    n = len(BANDS)
    rows = metrics.condensed(_scene(spark, sf_dir)[0].inside, lambda: 1 - metrics.jaccard())
    pos = F.col("a") * n - F.col("a") * (F.col("a") + 1) / 2 + F.col("b") - F.col("a") - 1
    return rows.select(pos.cast("int").alias("pos"), _round("value").alias("value"))


@query(f"WITH {_REGIONS} SELECT ra_id, n::BIGINT AS n, round(purity, 6) AS purity FROM pu")
def band_purity(spark, sf_dir):
    scene, _ = _scene(spark, sf_dir)
    return metrics.purity(scene.inside, scene.members).select("ra_id", "n", _round("purity").alias("purity"))


@query(f"WITH {_REGIONS} SELECT i.ra_id, i.sample_id FROM inside i JOIN members m ON i.ra_id = m.ra_id AND i.sample_id = m.sample_id")
def contained_members(spark, sf_dir):
    scene, _ = _scene(spark, sf_dir)
    return scene.inside.join(scene.members, ["ra_id", "sample_id"])


def _score_query(fn):
    def run(spark, sf_dir):
        return fn(*_scene(spark, sf_dir)).select("panel", _round("score").alias("score"))

    return run


_COUNTS = "vc AS (SELECT panel, var_id, count(*) AS n FROM pa GROUP BY ALL), pn AS (SELECT panel, count(*) AS n FROM pa GROUP BY 1)"
_JAC = "j AS (SELECT p.panel, avg(c / (n_a + n_b - c + 1e-8::DOUBLE)) AS j FROM pa p JOIN pa q ON p.panel = q.panel AND p.ra_id < q.ra_id JOIN pr ON pr.a = p.ra_id AND pr.b = q.ra_id GROUP BY 1)"
_SCORES = {
    "score_mean_occurrence": (scores.mean_variable_occurrence, "SELECT panel, avg(n) AS score FROM vc GROUP BY 1"),
    "score_all_regions": (scores.variable_occurs_in_all_regions, "SELECT vc.panel, sum((vc.n / pn.n >= 0.9)::INT) * greatest(0, max(pn.n) - 1)::DOUBLE AS score FROM vc JOIN pn USING (panel) GROUP BY 1"),
    "score_purity": (scores.mean_purity, "SELECT panel, avg(purity) AS score FROM pa JOIN pu USING (ra_id) GROUP BY 1"),
    "score_coverage": (scores.sample_coverage, "SELECT panel, count(DISTINCT sample_id) / (SELECT count(*) FROM e)::DOUBLE AS score FROM pa JOIN inside USING (ra_id) GROUP BY 1"),
    "score_base_vars": (scores.num_base_vars, "SELECT panel, count(DISTINCT var_id)::DOUBLE AS score FROM pa GROUP BY 1"),
    "score_overlap": (scores.mean_overlap, "SELECT panel, 1 - j AS score FROM j"),
    "score_perception": (scores.num_regions_matches_perception, "SELECT panel, exp(-((n - 3) / 2.0::DOUBLE) * ((n - 3) / 2.0::DOUBLE) / 2) / (2 * sqrt(2 * pi())) AS score FROM pn"),
}
for _name, (_fn, _sql) in _SCORES.items():
    _QUERIES[_name] = _score_query(_fn)
    _SQL[_name] = f"WITH {_REGIONS}, {_COUNTS}, {_JAC}, r0 AS ({_sql}) SELECT panel::INT AS panel, round(score, 6) AS score FROM r0"

_RANKS = ", ".join(f"s{i} AS ({_SCORES[n][1]}), k{i} AS (SELECT panel, count(*) OVER (ORDER BY round(score, 9) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM s{i})" for i, n in enumerate(("score_overlap", "score_purity", "score_perception")))
_RANKED = f"WITH {_REGIONS}, {_COUNTS}, {_JAC}, {_RANKS}, f AS (SELECT panel, (k0.k * 5 + k1.k * 5 + k2.k * 1) / 3.0::DOUBLE AS score FROM k0 JOIN k1 USING (panel) JOIN k2 USING (panel))"


@query(f"WITH {_REGIONS}, {_COUNTS}, {_JAC}, s0 AS ({_SCORES['score_perception'][1]}) SELECT panel::INT AS panel, (rank() OVER (ORDER BY round(score, 9)) + count(*) OVER (PARTITION BY round(score, 9)) - 1)::BIGINT AS rank FROM s0")
def rank_max(spark, sf_dir):
    rows = scores.num_regions_matches_perception(*_scene(spark, sf_dir))
    return scores.rank_max(rows.withColumn("score", _round("score", 9))).select("panel", "rank")


@query(_RANKED + " SELECT panel::INT AS panel, round(score, 6) AS score FROM f")
def mean_ranks(spark, sf_dir):
    return scores.ranked(*_scene(spark, sf_dir)).select("panel", _round("score").alias("score"))


@query(_RANKED + " SELECT panel::INT AS panel, round(score, 6) AS score FROM f ORDER BY score DESC, panel DESC LIMIT 2")
def top_panels(spark, sf_dir):
    return scores.top_panels(scores.ranked(*_scene(spark, sf_dir)), 2).select("panel", _round("score").alias("score"))


def _annotated(spark, sf_dir, features=("e0", "e1", "e2", "label"), **kw):
    from terrane.plans.annotate import generate_region_annotations

    e = embedded(spark, sf_dir).withColumn("twice", 2 * F.col("e0"))
    return generate_region_annotations(e.select("sample_id", *features), e.select("sample_id", "x", "y"), **kw)


def _listed(spark, space, panels) -> DataFrame:
    flat = [(k, i, a) for k, p in enumerate(panels) for i, a in enumerate(p)]
    rows = small_table(spark, [(n, k, i, a.name, len(a.leaves())) for n, (k, i, a) in enumerate(flat)], "ra_id int, panel int, pos int, name string, leaves int")
    return rows.join(metrics.sizes(space.inside([a for _, _, a in flat])) if flat else small_table(spark, [], "ra_id int, n long"), "ra_id", "left").drop("ra_id")


@query()
def region_annotations(spark, sf_dir):
    """The flagship: features and embedding to merged annotations."""
    space, groups = _annotated(spark, sf_dir)
    return _listed(spark, space, list(groups.values()))


def _bin_names() -> str:
    rows = []
    for v, e in EDGES.items():
        for i in range(len(e) + 1):
            lo, hi = (None if i == 0 else e[i - 1]), (None if i == len(e) else e[i])
            rows.append(f"({v * encode.IND + i}, {v}, {i}, '{rules.Interval(lo, hi, f'e{v}')}')")
    return "nm AS (SELECT ind::BIGINT AS ind_id, v::INT AS v, pos::INT AS pos, name FROM (VALUES " + ", ".join(rows) + ") t(ind, v, pos, name))"


@query(f"WITH {_INSIDE}, {_bin_names()} SELECT v AS panel, pos, name, 1::INT AS leaves, count(*)::BIGINT AS n FROM i JOIN nm USING (ind_id) GROUP BY ALL")
def region_annotations_fixed(spark, sf_dir):
    """The flagship with fixed edges and all samples, where no regions merge. Of the third variable all samples are in
    one bin: its other bin has no region, and with the only one left it goes."""
    space, groups = _annotated(spark, sf_dir, ("e0", "e1", "e2"), edges={**EDGES, 2: [5.0]}, sample_size=None)
    return _listed(spark, space, list(groups.values()))


@query(f"""WITH {_INSIDE}, {_bin_names()},
sz AS (SELECT ind_id, v, count(*) AS n FROM i JOIN nm USING (ind_id) GROUP BY ALL),
sh AS (SELECT p.ind_id AS a, q.ind_id AS b, count(*) AS c FROM i p JOIN i q ON p.sample_id = q.sample_id AND p.ind_id < q.ind_id GROUP BY ALL),
jc AS (SELECT p.v, 1 - avg(coalesce(c, 0) / (p.n + q.n - coalesce(c, 0) + 1e-8::DOUBLE)) AS s FROM sz p JOIN sz q ON p.v = q.v AND p.ind_id < q.ind_id LEFT JOIN sh ON sh.a = p.ind_id AND sh.b = q.ind_id GROUP BY 1),
pu AS (SELECT i.ind_id, avg((m.sample_id IS NOT NULL)::INT) AS p FROM i LEFT JOIN m ON m.ind_id = i.ind_id AND m.sample_id = i.sample_id GROUP BY 1),
mp AS (SELECT v, avg(p) AS s FROM pu JOIN nm USING (ind_id) GROUP BY 1),
f AS (SELECT v, (5 * count(*) OVER (ORDER BY jc.s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 5 * count(*) OVER (ORDER BY mp.s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 2) / 3 AS score FROM jc JOIN mp USING (v)),
o AS (SELECT v, (row_number() OVER (ORDER BY score DESC, v DESC) - 1)::INT AS panel FROM f)
SELECT panel, pos, name, 1::INT AS leaves, n::BIGINT AS n FROM o JOIN nm USING (v) JOIN sz USING (ind_id)""")
def contrastive_fixed(spark, sf_dir):
    """Contrastive panels of fixed bins, best first, from all samples."""
    from terrane.plans.contrastive import contrastive as run

    space, groups = _annotated(spark, sf_dir, ("e0", "e1"), edges=EDGES, sample_size=None)
    return _listed(spark, space, run(space, [a for g in groups.values() for a in g]))


@query()
def region_annotations_rangeset(spark, sf_dir):
    space, groups = _annotated(spark, sf_dir, ("e0", "e1"), region_method="rangeset", scale_factor=0.5, filter_uninformative_features=False)
    return _listed(spark, space, list(groups.values()))


@query()
def merge_overfragmented(spark, sf_dir):
    space, groups = _annotated(spark, sf_dir, ("e0", "e1"), merge_min_sample_overlap=0.4, filter_uninformative_features=False)
    return _listed(spark, space, list(groups.values()))


@query()
def contrastive(spark, sf_dir):
    from terrane.plans.contrastive import contrastive as run

    space, groups = _annotated(spark, sf_dir, ("e0", "e1", "twice"))
    return _listed(spark, space, run(space, [a for g in groups.values() for a in g]))


@query()
def contrastive_merge(spark, sf_dir):
    from terrane.plans.contrastive import merge_contrastive

    space, groups = _annotated(spark, sf_dir, ("e0", "twice"))
    return _listed(spark, space, merge_contrastive(space, [a for g in groups.values() for a in g]))


@query()
def descriptive(spark, sf_dir):
    from terrane.plans.descriptive import descriptive as run

    space, groups = _annotated(spark, sf_dir, ("e0", "e1"))
    return _listed(spark, space, run(space, [a for g in groups.values() for a in g]))


@query()
def descriptive_merge(spark, sf_dir):
    from terrane.plans.descriptive import descriptive_merge as run

    space, groups = _annotated(spark, sf_dir, ("e0", "twice"))
    return _listed(spark, space, [run(space, [a for g in groups.values() for a in g], threshold=0.8)])


@query()
def descriptive_layout(spark, sf_dir):
    from terrane.plans.descriptive import generate_layout

    space, groups = _annotated(spark, sf_dir, ("e0", "e1"))
    return _listed(spark, space, generate_layout(space, [a for g in groups.values() for a in g], max_panels=2))


# ---- interval and neighbour joins

_WINDOWS = """w1 AS (SELECT p_partkey AS id1, floor(p_retailprice)::DOUBLE AS start1, floor(p_retailprice)::DOUBLE + p_partkey % 3 AS end1 FROM part),
w2 AS (SELECT c_custkey AS id2, floor(c_acctbal)::DOUBLE AS start2, floor(c_acctbal)::DOUBLE + c_custkey % 4 AS end2 FROM customer)"""


def _windows(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    price, balance = F.floor("p_retailprice").cast("double"), F.floor("c_acctbal").cast("double")
    return part.select(F.col("p_partkey").alias("id1"), price.alias("start1"), (price + F.col("p_partkey") % 3).alias("end1")), customer.select(F.col("c_custkey").alias("id2"), balance.alias("start2"), (balance + F.col("c_custkey") % 4).alias("end2"))


@query(f"WITH {_WINDOWS} SELECT id1, id2 FROM w1, w2 WHERE (start1 <= start2 AND start2 < end1) OR (start2 < start1 AND start1 < end2)")
def interval_overlap_open(spark, sf_dir):
    return joins.overlap_intervals(*_windows(spark, sf_dir), width=8.0)


@query(f"WITH {_WINDOWS} SELECT id1, id2 FROM w1, w2 WHERE (start1 <= start2 AND start2 <= end1) OR (start2 < start1 AND start1 <= end2)")
def interval_overlap_closed(spark, sf_dir):
    return joins.overlap_intervals(*_windows(spark, sf_dir), width=8.0, closed=True)


@query("SELECT p_partkey, unnest(range(p_size::BIGINT - 3, p_size::BIGINT % 7)) AS value FROM part")
def arange_multi(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("long") - 3).alias("a"), (F.col("p_size").cast("long") % 7).alias("b"))
    return joins.arange_multi(df, "a", "b").select("p_partkey", "value")


@query(f"WITH {_E}, nn AS (SELECT a.sample_id AS src, b.sample_id AS dst, row_number() OVER (PARTITION BY a.sample_id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.sample_id) AS rn FROM e a JOIN e b ON a.sample_id <> b.sample_id), k AS (SELECT src, dst FROM nn WHERE rn <= 5) SELECT src, dst FROM k UNION SELECT dst, src FROM k")
def knn_graph(spark, sf_dir):
    return joins.knn_graph(_samples(spark, sf_dir), 5)


@query(f"WITH {_E} SELECT a.sample_id AS src, b.sample_id AS dst FROM e a JOIN e b ON a.sample_id <> b.sample_id WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 0.02")
def radius_graph(spark, sf_dir):
    return joins.radius_graph(_samples(spark, sf_dir), 0.02)


# ---- graphs: suppliers and customers of one nation, and regions

_GRAPH = """nd AS (SELECT c_custkey AS id FROM customer),
ed AS (SELECT a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND b.c_custkey = a.c_custkey + 25 + a.c_custkey % 7),
un AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed)"""
_PAIRS = f"WITH {_REGIONS}"


def _graph(spark, sf_dir) -> graph.Graph:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    step = c.select(F.col("c_custkey").alias("src"), "c_nationkey", (F.col("c_custkey") + 25 + F.col("c_custkey") % 7).alias("c_custkey"))
    edges = step.join(c, ["c_custkey", "c_nationkey"]).select("src", F.col("c_custkey").alias("dst"))
    return graph.Graph(c.select(F.col("c_custkey").alias("id")), edges)


def _undirected(spark, sf_dir) -> graph.Graph:
    g = _graph(spark, sf_dir)
    return graph.Graph(g.nodes, graph.to_undirected(g.edges))


def _region_graph(spark, sf_dir, threshold=0.1) -> graph.Graph:
    scene, _ = _scene(spark, sf_dir)
    pairs = metrics.pairs(scene.inside).select("a", "b", metrics.jaccard().alias("value"))
    return graph.similarities_to_graph(scene.vars.select(F.col("ra_id").alias("id")), pairs, threshold)


@query(f"{_PAIRS}, v AS (SELECT a, b FROM pr WHERE c / (n_a + n_b - c + 1e-8::DOUBLE) > 0.1) SELECT a AS src, b AS dst FROM v UNION SELECT b, a FROM v")
def graph_threshold_sim(spark, sf_dir):
    return _region_graph(spark, sf_dir).edges


@query(f"{_PAIRS}, v AS (SELECT a, b FROM pr WHERE 1 - c / (n_a + n_b - c + 1e-8::DOUBLE) < 0.9) SELECT a AS src, b AS dst FROM v UNION SELECT b, a FROM v UNION SELECT ra_id, ra_id FROM b")
def graph_threshold_dist(spark, sf_dir):
    scene, _ = _scene(spark, sf_dir)
    pairs = metrics.pairs(scene.inside).select("a", "b", (1 - metrics.jaccard()).alias("value"))
    return graph.distances_to_graph(scene.vars.select(F.col("ra_id").alias("id")), pairs, 0.9).edges


@query(f"WITH {_GRAPH} SELECT src, dst FROM un")
def graph_undirected(spark, sf_dir):
    return _undirected(spark, sf_dir).edges


@query(f"WITH {_GRAPH} SELECT id, count(un.src)::BIGINT AS degree FROM nd LEFT JOIN un ON un.src = nd.id GROUP BY 1")
def graph_degrees(spark, sf_dir):
    return graph.degrees(_undirected(spark, sf_dir))


@query(f"WITH {_GRAPH} SELECT id, coalesce(string_agg(un.dst::VARCHAR, ',' ORDER BY un.dst), '') AS neighbours FROM nd LEFT JOIN un ON un.src = nd.id GROUP BY 1")
def graph_adjacency(spark, sf_dir):
    rows = graph.adjacency(graph.from_adjacency(graph.adjacency(_undirected(spark, sf_dir))))
    return rows.select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL")
def graph_from_matrix(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum(F.when(F.col("l_quantity") >= 25, 1).otherwise(0)).alias("value"))
    return graph.from_matrix(cells).edges


@query(f"WITH {_GRAPH} SELECT DISTINCT s.c_nationkey + 100 * (s.c_custkey % 2) AS src, d.c_nationkey + 100 * (d.c_custkey % 2) AS dst FROM un JOIN customer s ON s.c_custkey = un.src JOIN customer d ON d.c_custkey = un.dst")
def graph_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 100 * (F.col("c_custkey") % 2)).alias("label"))
    return graph.label_nodes(_undirected(spark, sf_dir), labels).edges


@query(f"{_PAIRS}, v AS (SELECT a, b FROM pr WHERE c / (n_a + n_b - c + 1e-8::DOUBLE) > 0.1), u AS (SELECT a AS src, b AS dst FROM v UNION SELECT b, a FROM v) SELECT x.ra_id AS src, y.ra_id AS dst FROM b x, b y WHERE x.ra_id <> y.ra_id EXCEPT SELECT src, dst FROM u")
def graph_complement(spark, sf_dir):
    return graph.complement(_region_graph(spark, sf_dir)).edges


@query(f"WITH {_GRAPH}, x AS (SELECT * FROM un UNION SELECT 1, 2 UNION SELECT 2, 1) SELECT DISTINCT CASE WHEN src IN (1, 2) THEN 999999999 ELSE src END AS src, CASE WHEN dst IN (1, 2) THEN 999999999 ELSE dst END AS dst FROM x WHERE NOT (src IN (1, 2) AND dst IN (1, 2))")
def graph_merge_nodes(spark, sf_dir):
    g = _undirected(spark, sf_dir)
    extra = small_table(spark, [(1, 2), (2, 1)], "src long, dst long")
    return graph.merge_nodes(graph.Graph(g.nodes, g.edges.unionByName(extra).distinct()), 1, 2, 999999999).edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(f"WITH {_GRAPH} SELECT src, dst FROM un WHERE src <> dst")
def graph_no_loops(spark, sf_dir):
    g = _undirected(spark, sf_dir)
    loops = g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return graph.remove_self_loops(graph.Graph(g.nodes, g.edges.unionByName(loops))).edges


@query(f"WITH RECURSIVE {_GRAPH}, c(id, r) AS (SELECT id, id FROM nd UNION SELECT un.dst, c.r FROM c JOIN un ON un.src = c.id WHERE un.dst > c.r) SELECT id, min(r) AS component FROM c GROUP BY 1")
def graph_components(spark, sf_dir):
    return graph.connected_components(_graph(spark, sf_dir))


def _sets_query(fn):
    def run(spark, sf_dir):
        found = fn(graph.as_sets(_region_graph(spark, sf_dir)))
        return small_table(spark, [(",".join(map(str, sorted(s))), len(s)) for s in found], "nodes string, n int")

    return run


_SUBSETS = f"""{_PAIRS.replace('WITH ', 'WITH RECURSIVE ')}, v AS (SELECT a, b FROM pr WHERE c / (n_a + n_b - c + 1e-8::DOUBLE) > 0.1), u AS (SELECT a AS src, b AS dst FROM v UNION SELECT b, a FROM v),
al AS (SELECT x.ra_id AS src, y.ra_id AS dst FROM b x, b y WHERE x.ra_id <> y.ra_id),
ok AS (%s),
cq(s, last) AS (SELECT [ra_id], ra_id FROM b UNION ALL SELECT list_append(s, ra_id), ra_id FROM cq, b WHERE ra_id > last AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(s) AS q) z WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.src = z.q AND ok.dst = b.ra_id)))
SELECT array_to_string(s, ',') AS nodes, len(s)::INT AS n FROM cq c1 WHERE NOT EXISTS (SELECT 1 FROM b WHERE NOT list_contains(c1.s, ra_id) AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(c1.s) AS q) z WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.src = z.q AND ok.dst = b.ra_id)))"""
_QUERIES["graph_cliques"] = _sets_query(graph.max_cliques)
_QUERIES["graph_independent_sets"] = _sets_query(graph.independent_sets)
_SETS_WITH = lambda ok: _SUBSETS % ok
_SQL["graph_cliques"] = _SETS_WITH("SELECT src, dst FROM u")
_SQL["graph_independent_sets"] = _SETS_WITH("SELECT src, dst FROM al EXCEPT SELECT src, dst FROM u")


@query(f"""{_PAIRS.replace('WITH ', 'WITH RECURSIVE ')}, v AS (SELECT a, b FROM pr WHERE c / (n_a + n_b - c + 1e-8::DOUBLE) > 0.1), u AS (SELECT a AS src, b AS dst FROM v UNION SELECT b, a FROM v),
dg AS (SELECT ra_id AS id, count(u.src) AS d FROM b LEFT JOIN u ON u.src = b.ra_id GROUP BY 1),
od AS (SELECT 'given' AS strategy, id, row_number() OVER (ORDER BY id) AS pos FROM dg UNION ALL SELECT 'degree', id, row_number() OVER (ORDER BY d, id) FROM dg UNION ALL SELECT 'largest_first', id, row_number() OVER (ORDER BY d DESC, id) FROM dg),
cl(strategy, pos, done) AS (SELECT DISTINCT strategy, 0::BIGINT, map([-1], [-1]) FROM od
 UNION ALL SELECT cl.strategy, o.pos, map_concat(cl.done, map([o.id], [list_min(list_filter([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], lambda k: NOT list_contains(list_transform(nb.ns, lambda q: coalesce(cl.done[q], -1)), k)))]))
 FROM cl JOIN od o ON o.strategy = cl.strategy AND o.pos = cl.pos + 1 JOIN (SELECT ra_id AS id, coalesce(list(u.dst) FILTER (WHERE u.dst IS NOT NULL), []) AS ns FROM b LEFT JOIN u ON u.src = b.ra_id GROUP BY 1) nb ON nb.id = o.id)
SELECT strategy, id::INT AS id, color::INT AS color FROM (SELECT strategy, unnest(map_keys(done)) AS id, unnest(map_values(done)) AS color FROM cl WHERE pos = 10) WHERE id >= 0""")
def graph_coloring(spark, sf_dir):
    g = graph.as_sets(_region_graph(spark, sf_dir))
    rows = [(o, v, c) for o in ("given", "degree", "largest_first") for v, c in graph.greedy_coloring(g, o).items()]
    return small_table(spark, rows, "strategy string, id int, color int")


@query(f"""WITH {_GRAPH}, o AS (SELECT DISTINCT src, dst FROM un WHERE src <= dst),
en AS (SELECT src AS node, md5(concat_ws(':', src, dst, 'a', 3)) AS h FROM o UNION ALL SELECT dst, md5(concat_ws(':', src, dst, 'b', 3)) FROM o),
pl AS (SELECT *, substr(h, 1, 2) AS rg, row_number() OVER (PARTITION BY substr(h, 1, 2) ORDER BY h, node) - 1 AS n, count(*) OVER (PARTITION BY substr(h, 1, 2)) AS sz FROM en),
ii AS (SELECT arg_min(node, n) AS src, arg_max(node, n) AS dst FROM pl WHERE NOT (n = sz - 1 AND sz % 2 = 1) GROUP BY rg, n // 2),
rs AS (SELECT node, row_number() OVER (ORDER BY rg) - 1 AS n FROM pl WHERE n = sz - 1 AND sz % 2 = 1),
oo AS (SELECT arg_min(node, n) AS src, arg_max(node, n) AS dst FROM rs GROUP BY n // 2)
SELECT src, dst FROM ii UNION ALL SELECT src, dst FROM oo""")
def configuration_graph(spark, sf_dir):
    return graph.configuration_graph(_undirected(spark, sf_dir), 3)


# ---- plot data


@query("SELECT p_partkey, round(greatest(p_size::DOUBLE, p_retailprice / 100), 6) AS value FROM part")
def feature_agg_max(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 100).alias("price"))
    return plotdata.feature_values(df, ["p_size", "price"], "p_partkey").select("p_partkey", _round("value").alias("value"))


@query("SELECT p_partkey, round(ln(1 + p_size::DOUBLE + p_retailprice), 6) AS value FROM part")
def feature_agg_sum(spark, sf_dir):
    return plotdata.feature_values(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], "p_partkey", agg="sum", log=True).select("p_partkey", _round("value").alias("value"))


@query("SELECT p_partkey, (p_size > 40 OR p_retailprice > 1500)::INT::DOUBLE AS value, 'large' AS name FROM (SELECT p_partkey, p_size, p_retailprice FROM part) UNION ALL SELECT p_partkey, (p_size > 40)::INT::DOUBLE, 'size' FROM part")
def feature_any_threshold(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("price", F.when(F.col("p_retailprice") > 1500, 41).otherwise(0))
    return plotdata.marker_values(df, {"large": ["p_size", "price"], "size": ["p_size"]}, "p_partkey", binary=True, threshold=40.0)


@query(f"WITH {_SMOOTH} SELECT ind_id, least(floor(round(z_max, 9) * 5), 4)::INT AS band, count(*)::BIGINT AS n FROM zm GROUP BY ALL")
def density_bands(spark, sf_dir):
    samples, scale, grid, ind = _frame(spark, sf_dir)
    rows = density(binned(samples, grid, ind.membership), grid, scale).withColumn("z_max", _round("z_max", 9))
    return plotdata.density_bands(rows, 5).groupBy("ind_id", "band").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::INT AS bucket, count(*)::BIGINT AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1")
def discretization_histogram(spark, sf_dir):
    return plotdata.discretization_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20)


@query(f"WITH {_REGIONS} SELECT sample_id, 'c' || (max(ra_id) % 4)::VARCHAR AS color FROM inside GROUP BY 1")
def membership_colors(spark, sf_dir):
    scene, _ = _scene(spark, sf_dir)
    colors = scene.vars.select("ra_id", F.concat(F.lit("c"), (F.col("ra_id") % 4).cast("string")).alias("color"))
    return plotdata.sample_colors(scene.inside, colors)


@query(f"WITH {_REGIONS} SELECT sample_id, 'c' || (max(ra_id) % 4)::VARCHAR AS color FROM inside JOIN members USING (ra_id, sample_id) GROUP BY 1")
def member_colors(spark, sf_dir):
    scene, _ = _scene(spark, sf_dir)
    colors = scene.vars.select("ra_id", F.concat(F.lit("c"), (F.col("ra_id") % 4).cast("string")).alias("color"))
    return plotdata.sample_colors(scene.inside, colors, scene.members)


@query("SELECT (r_regionkey * 7)::INT AS panel, (r_regionkey * 7 // 4)::INT AS row, (r_regionkey * 7 % 4)::INT AS col, chr((97 + (r_regionkey * 7) % 26)::INT) AS letter FROM region")
def panel_grid(spark, sf_dir):
    return plotdata.panel_grid(table(spark, sf_dir, "region").select((F.col("r_regionkey") * 7).cast("int").alias("panel")))


@query(f"WITH {_REGIONS} SELECT ra_id, round(0.8 * (0.75 * purity + 0.25), 6) AS alpha FROM pu")
def purity_alpha(spark, sf_dir):
    scene, _ = _scene(spark, sf_dir)
    return metrics.purity(scene.inside, scene.members).select("ra_id", _round(plotdata.purity_alpha(F.col("purity"), 0.8)).alias("alpha"))


@query("SELECT n_nationkey, ((dense_rank() OVER (ORDER BY n_regionkey::VARCHAR) - 1) % 3)::INT AS color FROM nation")
def variable_colors(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("descriptor"))
    return plotdata.variable_colors(rows, 3).select("n_nationkey", "color")


@query(f"WITH {_E} SELECT a.sample_id AS src, b.sample_id AS dst, round(a.x, 6) AS x0, round(a.y, 6) AS y0, round(b.x, 6) AS x1, round(b.y, 6) AS y1 FROM e a JOIN e b ON a.sample_id < b.sample_id WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 0.02")
def graph_segments(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    rows = plotdata.graph_segments(joins.radius_graph(samples, 0.02), samples)
    return rows.select("src", "dst", *[_round(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


# ---- boxes and labels

_BOX = "bx AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + l_tax * 100 + 1 AS x1, l_discount * 100 + 5 AS y1, l_orderkey % 100 AS p FROM lineitem)"


def _boxes(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    y = F.col("l_discount") * 100
    return li.select("l_orderkey", "l_linenumber", boxes.box(F.col("l_quantity"), y, F.col("l_quantity") + F.col("l_tax") * 100 + 1, y + 5).alias("b"), (F.col("l_orderkey") % 100).cast("double").alias("p"))


def _edges(df: DataFrame, made) -> DataFrame:
    return df.withColumn("m", made).select("l_orderkey", "l_linenumber", *[_round(F.col(f"m.{f}")).alias(f) for f in boxes.FIELDS])


@query(f"WITH {_BOX}, k AS (SELECT *, greatest((y1-y0)-(x1-x0), 0) / 2 AS mx, greatest((x1-x0)-(y1-y0), 0) / 2 AS my FROM bx) SELECT l_orderkey, l_linenumber, round(x0 - mx, 6) AS x0, round(y0 - my, 6) AS y0, round(x1 + mx, 6) AS x1, round(y1 + my, 6) AS y1 FROM k")
def bbox_square(spark, sf_dir):
    return _edges(_boxes(spark, sf_dir), boxes.square(F.col("b")))


@query(f"WITH {_BOX} SELECT l_orderkey, l_linenumber, round(x0 - (x1-x0) * 0.5, 6) AS x0, round(y0 - (y1-y0) * 0.25, 6) AS y0, round(x1 + (x1-x0) * 0.5, 6) AS x1, round(y1 + (y1-y0) * 0.25, 6) AS y1 FROM bx")
def bbox_pad(spark, sf_dir):
    return _edges(_boxes(spark, sf_dir), boxes.padded(F.col("b"), 0.5, 0.25))


@query(f"WITH {_BOX}, k AS (SELECT *, greatest(abs(3 - y0), abs(3 - y1)) AS hy FROM bx) SELECT l_orderkey, l_linenumber, round(p - greatest(abs(p-x0), abs(p-x1)), 6) AS x0, round(3 - hy, 6) AS y0, round(p + greatest(abs(p-x0), abs(p-x1)), 6) AS x1, round(3 + hy, 6) AS y1 FROM k")
def bbox_center(spark, sf_dir):
    return _edges(_boxes(spark, sf_dir), boxes.centred(F.col("b"), point=(F.col("p"), F.lit(3.0))))


@query(f"WITH {_BOX}, k AS (SELECT *, greatest((x1-x0) - 2 / 0.5, 0) / 2 AS cx, greatest((y1-y0) - 2 / 0.5, 0) / 2 AS cy FROM bx) SELECT l_orderkey, l_linenumber, round(x0 + cx, 6) AS x0, round(y0 + cy, 6) AS y0, round(x1 - cx, 6) AS x1, round(y1 - cy, 6) AS y1 FROM k")
def scatter_min_size(spark, sf_dir):
    inner = boxes.box(*[F.lit(v) for v in (10.0, 2.0, 12.0, 4.0)])
    return _edges(_boxes(spark, sf_dir), boxes.at_least(F.col("b"), inner, 0.5))


@query(f"WITH {_BOX} SELECT l_orderkey, l_linenumber, round(0.1 * greatest(x1-x0, y1-y0), 6) AS longer, round(0.1 * least(x1-x0, y1-y0), 6) AS shorter FROM bx")
def axis_units(spark, sf_dir):
    b = F.col("b")
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", _round(boxes.axis_units(b, 0.1)).alias("longer"), _round(boxes.axis_units(b, 0.1, "min")).alias("shorter"))


@query(f"WITH {_BOX} SELECT l_orderkey, l_linenumber, round(x0 * 1 + x1 * 2 + x1 * 3 + x0 * 4 + x0 * 5, 6) AS xs, 5::INT AS n FROM bx")
def bbox_ring(spark, sf_dir):
    ring = boxes.ring(F.col("b"))
    xs = F.aggregate(F.transform(ring, lambda p, i: p["x"] * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", _round(xs).alias("xs"), F.size(ring).alias("n"))


@query(f"""WITH {_BOX} SELECT l_orderkey, l_linenumber,
 (((p - y0) * (x1 - x0) > (y1 - y0) * (3 - x0)) <> ((4 - y0) * (x1 - x0) > (y1 - y0) * (30 - x0))) AND
 (((y0 - p) * (30 - 3) > (4 - p) * (x0 - 3)) <> ((y1 - p) * (30 - 3) > (4 - p) * (x1 - 3))) AS crosses FROM bx""")
def segment_crossings(spark, sf_dir):
    b, p = F.col("b"), F.col("p")
    made = boxes.crossing((F.lit(3.0), p), (F.lit(30.0), F.lit(4.0)), (b["x0"], b["y0"]), (b["x1"], b["y1"]))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", made.alias("crosses"))


@query(f"WITH {_BOX} SELECT l_orderkey, l_linenumber, round(greatest(least(x1, 20) - greatest(x0, 10), 0) * greatest(least(y1, 6) - greatest(y0, 1), 0), 6) AS area FROM bx")
def label_overlap(spark, sf_dir):
    fixed = boxes.box(*[F.lit(v) for v in (10.0, 1.0, 20.0, 6.0)])
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", _round(boxes.overlap_area(F.col("b"), fixed)).alias("area"))


@query()
def label_quality(spark, sf_dir):
    """Labels of the bins' regions: placed, uncrossed, moved along the forces, and their faults."""
    import numpy as np

    from terrane.operators import labels

    _, grid, _, cells = _cells(spark, sf_dir)
    rings = geometry.outlines(cells, grid).where("NOT hole").orderBy("ind_id", "ring").toPandas()  # outlines of a panel
    rings = rings.loc[rings.groupby("ind_id")["area"].idxmax()]
    rows = []
    for panel, own in rings.groupby(rings["ind_id"] // encode.IND):
        shapes = [np.array([(p["x"], p["y"]) for p in pts]) for pts in own["points"]]
        every = np.vstack(shapes)
        centre = (every.min(0) + every.max(0)) / 2
        targets = own[["cx", "cy"]].to_numpy()
        places = labels.initial_places(centre, np.linalg.norm(every - centre, axis=1).max(), targets)
        places = labels.fix_crossings(places, targets)
        axes = labels.Axes((*(places.min(0) - 0.1), *(places.max(0) + 0.1)))
        w, h = labels.text_extent("0.00 < e0 < 0.00", 0.02, 0.02)
        around = geometry.hull(every)
        moved = labels.optimize([labels.box_ring((x - w / 2, y - h / 2, x + w / 2, y + h / 2)) for x, y in places], shapes, around, axes)
        faults = labels.quality(moved, shapes, axes)
        rows.append((int(panel), float(labels.penalty(faults)), *[faults[k] for k in labels.PENALTIES]))
    return small_table(spark, rows, "panel int, penalty double, " + ", ".join(f"{k} double" for k in labels.PENALTIES))


# ---- areas


def _cut_sql(a: str, b: str) -> str:
    return f"(({a} - 0.25::DOUBLE) / ({a} - {b}))"


def _area_sql() -> str:
    """Share of a cell above the level, by its corners a = 00, b = 10, c = 01, d = 11."""
    z = {"a": "z00", "b": "z10", "c": "z01", "d": "z11"}
    beside = {"a": "bc", "b": "ad", "c": "da", "d": "cb"}
    tri = {k: f"({_cut_sql(z[k], z[n[0]])} * {_cut_sql(z[k], z[n[1]])} / 2)" for k, n in beside.items()}
    side = lambda p, q, r, s: f"({_cut_sql(z[p], z[q])} + {_cut_sql(z[r], z[s])}) / 2"
    one = " ".join(f"WHEN n = 1 AND {k} THEN {tri[k]}" for k in z)
    three = " ".join(f"WHEN n = 3 AND NOT {k} THEN 1 - {tri[k]}" for k in z)
    two = f"WHEN a AND c THEN {side('a', 'b', 'c', 'd')} WHEN b AND d THEN {side('b', 'a', 'd', 'c')} WHEN a AND b THEN {side('a', 'c', 'b', 'd')} WHEN c AND d THEN {side('c', 'a', 'd', 'b')}"
    mean = "(z00 + z10 + z01 + z11) / 4 > 0.25"
    saddle = f"WHEN a AND d THEN CASE WHEN {mean} THEN 1 - {tri['b']} - {tri['c']} ELSE {tri['a']} + {tri['d']} END ELSE CASE WHEN {mean} THEN 1 - {tri['a']} - {tri['d']} ELSE {tri['b']} + {tri['c']} END"
    return f"CASE WHEN n = 4 THEN 1 {one} {three} {two} {saddle} END"


@query(f"""WITH {_INSIDE}, ar AS (SELECT ind_id, {_area_sql()} AS s FROM (SELECT *, (z00 > 0.25)::INT + (z10 > 0.25)::INT + (z01 > 0.25)::INT + (z11 > 0.25)::INT AS n, z00 > 0.25 AS a, z10 > 0.25 AS b, z01 > 0.25 AS c, z11 > 0.25 AS d FROM cl) WHERE n > 0)
SELECT ind_id, round(sum(s) * any_value(dx * dy), 6) AS area FROM ar, g GROUP BY 1""")
def region_area(spark, sf_dir):
    _, grid, _, cells = _cells(spark, sf_dir)
    return geometry.region_areas(cells, grid).select("ind_id", _round("area").alias("area"))


@query()
def area_iou(spark, sf_dir):
    _, grid, _, cells = _cells(spark, sf_dir)
    rows = geometry.area_metrics(geometry.intersection_areas(cells, grid))
    return rows.select("a", "b", *[_round(c).alias(c) for c in ("area_a", "area_b", "area", "intersection_percentage", "iou", "iou_dist")])


@query()
def hull_ratio(spark, sf_dir):
    _, grid, _, cells = _cells(spark, sf_dir)
    cells = cells.persist()
    return geometry.hull_ratio(geometry.intersection_areas(cells, grid), geometry.outlines(cells, grid)).select("a", "b", _round("ratio").alias("ratio"))


@query()
def region_outlines(spark, sf_dir):
    _, grid, _, cells = _cells(spark, sf_dir)
    return geometry.outlines(cells, grid).select("ind_id", "part_id", "hole", _round("area").alias("area"), F.size("points").alias("n"))


@query()
def region_anchors(spark, sf_dir):
    _, grid, _, cells = _cells(spark, sf_dir)
    return geometry.anchors(geometry.outlines(cells, grid)).select("ind_id", _round("x").alias("x"), _round("y").alias("y"))


# ---- streams


@query(f"WITH {_E}, {_MEMBERS} SELECT ind_id, sample_id FROM m")
def stream_assign(spark, sf_dir):
    """Bins with fixed edges of a stream of vectors."""
    from terrane.streaming.assign import assign_once

    return assign_once(spark, sf_dir, EDGES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from terrane import plan_queries  # noqa: F401 (registers its queries here)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
