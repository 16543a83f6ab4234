"""Registered queries of the plans, on fixed rectangular regions, and of areas, on regions with straight borders.

The annotations here are bands of x, y and 2 x; where samples lie in them SQL can tell from the raw table. The
queries call the same functions as the flagship does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import lists, rules
from terrane.operators import geometry, plotdata, regions
from terrane.operators.embedding import Grid
from terrane.operators.encode import Indicators
from terrane.operators.metrics import sizes
from terrane.plans import annotate, contrastive, descriptive
from terrane.queries import _E, _RULES, _SCORES, BANDS, _binned_members, _round, query
from terrane.sources.ingest import UnsupportedColumn, ingest, predicates
from terrane.sources.tables import embedded, small_table, table

#: The bands of x again, as bands of a variable that is 2 x: the same regions by another description.
TWICE = [(10 + i, 2, 2 * lo, 2 * hi) for i, (_, v, lo, hi) in enumerate(BANDS) if v == 0]


def _bands(twice: bool) -> list[tuple]:
    return BANDS + (TWICE if twice else [])


def _space(spark, sf_dir, twice: bool = False) -> tuple[annotate.Space, list[annotate.Annotation]]:
    bands = _bands(twice)
    e = embedded(spark, sf_dir).select("sample_id", "x", "y")
    value = (F.col("x"), F.col("y"), 2 * F.col("x"))

    def within(shift: float) -> DataFrame:
        hit = [F.when((value[v] >= lo + shift * (1 + v // 2)) & (value[v] < hi + shift * (1 + v // 2)), F.lit(r).cast("long")) for r, v, lo, hi in bands]
        return e.select("sample_id", F.explode(F.array_compact(F.array(*hit))).alias("ind_id"))

    indicators = small_table(spark, [(r, v, f"e{v}", r % 5) for r, v, _, _ in bands], "ind_id long, var_id int, var string, ord int")
    space = annotate.Space(e, Indicators(indicators, within(0.05)), 0.0, None, within(0.0).withColumn("part_id", F.lit(0)), None)
    made = [annotate.Annotation((annotate.Clause(v, rules.Interval(lo, hi, f"e{v}"), frozenset((r,))),), frozenset(((r, 0),))) for r, v, lo, hi in bands]
    return space, made


def _ras(a: annotate.Annotation) -> str:
    return ",".join(str(i) for i, _ in sorted(a.pieces))


def _panels(space: annotate.Space, panels: list[list[annotate.Annotation]]) -> DataFrame:
    """(panel, pos, name, ras, leaves, n) of the annotations of every panel."""
    flat = [(k, i, a) for k, p in enumerate(panels) for i, a in enumerate(p)]
    rows = small_table(space.spark, [(n, k, i, a.name, _ras(a), len(a.leaves())) for n, (k, i, a) in enumerate(flat)], "ra_id int, panel int, pos int, name string, ras string, leaves int")
    if not flat:
        return rows.drop("ra_id").withColumn("n", F.lit(0).cast("long"))
    return rows.join(sizes(space.inside([a for _, _, a in flat])), "ra_id", "left").drop("ra_id")


def _sql(twice: bool = False) -> str:
    rows = ", ".join(f"({r}, {v}, {lo}::DOUBLE, {hi}::DOUBLE)" for r, v, lo, hi in _bands(twice))
    at = "CASE var_id WHEN 0 THEN x WHEN 1 THEN y ELSE 2 * x END"
    shift = "0.05::DOUBLE * (1 + var_id // 2)"
    return f"""WITH RECURSIVE {_E},
b AS (SELECT ra::INT AS ra_id, v::INT AS var_id, lo, hi FROM (VALUES {rows}) t(ra, v, lo, hi)),
inside AS MATERIALIZED (SELECT ra_id, var_id, sample_id FROM e, b WHERE {at} >= lo AND {at} < hi),
members AS MATERIALIZED (SELECT ra_id, sample_id FROM e, b WHERE {at} >= lo + {shift} AND {at} < hi + {shift}),
n AS MATERIALIZED (SELECT ra_id, count(*) AS n FROM inside GROUP BY 1),
sh AS MATERIALIZED (SELECT p.ra_id AS a, q.ra_id AS b, count(*) AS c FROM inside p JOIN inside q ON p.sample_id = q.sample_id AND p.ra_id < q.ra_id GROUP BY ALL),
pr AS MATERIALIZED (SELECT p.ra_id AS a, q.ra_id AS b, p.n AS n_a, q.n AS n_b, coalesce(c, 0) AS c FROM n p JOIN n q ON p.ra_id < q.ra_id LEFT JOIN sh ON sh.a = p.ra_id AND sh.b = q.ra_id),
pu AS MATERIALIZED (SELECT i.ra_id, avg((m.sample_id IS NOT NULL)::INT) AS purity, count(*) AS n FROM inside i LEFT JOIN members m ON i.ra_id = m.ra_id AND i.sample_id = m.sample_id GROUP BY 1)"""


def _named(lo: str = "lo", hi: str = "hi", v: str = "var_id") -> str:
    return f"printf('%.2f < e%d < %.2f', {lo}, {v}, {hi})"


# ---- rules, lists, columns


@query("SELECT id::INT AS id, (row_number() OVER (PARTITION BY kind ORDER BY k, id) - 1)::INT AS pos FROM (VALUES " + ", ".join(f"({n}, '{k}', {'-1e300' if lo == '-inf' else lo if k == 'i' else min(v.split(','))}::DOUBLE)" for n, (k, lo, _, v) in enumerate(_RULES)) + ") t(id, kind, k)")
def rule_order(spark, sf_dir):
    """Rules of either kind in their order; rules that differ in their names only are one."""
    number = lambda x: float(x) if isinstance(x, str) else x
    out = []
    for kind in "iv":
        made = [(n, rules.Interval(number(lo), number(up)) if k == "i" else rules.Equals(int(v)) if "," not in v else rules.OneOf({int(x) for x in v.split(",")})) for n, (k, lo, up, v) in enumerate(_RULES) if k == kind]
        if len({r for _, r in made}) != len(made) or kind == "i" and len({rules.Interval(r.lower, r.upper, name, 3) for _, r in made for name in "ab"}) != len(made):
            raise AssertionError("equality of rules")
        out += [(n, i) for i, (n, _) in enumerate(sorted(made, key=lambda x: x[1]))]
    return small_table(spark, out, "id int, pos int")


@query("""
WITH b AS (SELECT DISTINCT floor(l_quantity / 10)::INT AS b FROM lineitem WHERE floor(l_quantity / 10)::INT <> 2),
g AS (SELECT b, b - row_number() OVER (ORDER BY b) AS run FROM b)
SELECT (min(b) * 10)::DOUBLE AS lower, (max(b) * 10 + 10)::DOUBLE AS upper, count(*)::BIGINT AS n FROM g GROUP BY run""")
def merge_indicators(spark, sf_dir):
    """The rules of one variable's indicators, merged where they meet."""
    b = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 10).cast("int").alias("b")).distinct().where("b <> 2")
    own = [rules.Interval(10.0 * r["b"], 10.0 * r["b"] + 10) for r in b.collect()]  # a rule for each bin
    return small_table(spark, [(m.lower, m.upper, sum(m.contains(r) for r in own)) for m in rules.merge_rules(own)], "lower double, upper double, n long")


@query("SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS pos, n_name FROM nation")
def flatten_lists(spark, sf_dir):
    """Names nested ever deeper, in order."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("names")).collect()
    out = []
    for r in rows:
        nested: list = []
        for name in reversed(r["names"]):
            nested = [[name], nested] if len(nested) % 2 else [name, nested]
        out += [(r["n_regionkey"], i, name) for i, name in enumerate(lists.flatten(nested))]
    return small_table(spark, out, "n_regionkey int, pos int, n_name string")


_TYPES = {"p_partkey": "continuous", "p_name": "discrete", "p_size": "continuous", "p_retailprice": "continuous", "flag": "continuous", "code": "discrete"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}')" for n, k in _TYPES.items()) + ", ('xs', 'rejected'), ('when', 'rejected'), ('strict', 'rejected')) v(name, kind)")
def variable_kinds(spark, sf_dir):
    """What kind of variable a column makes by its type, and what is rejected."""
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_partkey", "p_name", "p_size", "p_retailprice", (F.col("p_size") > 3).alias("flag"), F.col("p_size").alias("code"))
    rows = [(r["name"], r["kind"]) for r in ingest(df, "id", categorical={"code"}).variables.collect()]
    odd = {"xs": (df.select("id", F.array("p_size").alias("xs")), False), "when": (df.select("id", F.current_date().alias("when")), False), "strict": (df.select("id", F.col("p_name").alias("strict")), True)}
    for name, (one, strict) in odd.items():
        try:
            ingest(one, "id", strict=strict)
        except UnsupportedColumn:
            rows.append((name, "rejected"))
    return small_table(spark, rows, "name string, kind string")


@query("""
SELECT 'e0' AS name, false AS is_discrete, true AS is_continuous, false AS is_indicator, false AS is_derived, 1::BIGINT AS n
UNION ALL SELECT 'e1', false, true, false, false, 1 UNION ALL SELECT 'e0', false, false, true, true, 5 UNION ALL SELECT 'e1', false, false, true, true, 5""")
def variable_predicates(spark, sf_dir):
    data = ingest(embedded(spark, sf_dir).select("sample_id", "e0", "e1"), "sample_id")
    rows = predicates(data.variables, _binned_members(spark, sf_dir).indicators)
    return rows.groupBy("name", "is_discrete", "is_continuous", "is_indicator", "is_derived").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT p_partkey, string_split(concat_ws(' ', p_name, p_type, p_brand), ' ') AS ws FROM part)
SELECT p_partkey, list_reduce(ws, lambda acc, w: acc || CASE WHEN length(regexp_extract(acc, '[^\n]*$')) + 1 + length(w) <= 20 THEN ' ' ELSE chr(10) END || w) AS text FROM w""")
def wrapped_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", plotdata.wrapped(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 20).alias("text"))


# ---- annotations


@query(_sql() + """
SELECT 0::INT AS ra_id, p.sample_id FROM members p JOIN members q USING (sample_id) WHERE p.ra_id = 2 AND q.ra_id = 7
UNION ALL SELECT DISTINCT 1, sample_id FROM members WHERE ra_id IN (1, 3)
UNION ALL SELECT DISTINCT 2, p.sample_id FROM members p JOIN members q USING (sample_id) WHERE p.ra_id IN (0, 2) AND q.ra_id IN (6, 9)""")
def indicator_groups(spark, sf_dir):
    """Samples of descriptions: all clauses must hold, of a clause any indicator."""
    space, made = _space(spark, sf_dir)
    both = annotate.merge_annotations([made[2], made[7]])
    return space.members([both, annotate.merge_annotations([made[1], made[3]]) if made[1].can_merge_with(made[3]) else _any(made[1], made[3]), annotate.Annotation((_any(made[0], made[2]).clauses[0], _any(made[6], made[9]).clauses[0]), both.pieces)])


def _any(a: annotate.Annotation, b: annotate.Annotation) -> annotate.Annotation:
    one, two = a.clauses[0], b.clauses[0]
    return annotate.Annotation((annotate.Clause(one.var_id, one.rule, one.inds | two.inds),), a.pieces | b.pieces)


@query(_sql(True) + f""", t AS (SELECT p.ra_id AS a, q.ra_id AS b, p.var_id <> q.var_id OR (p.lo <= q.hi AND q.lo <= p.hi) AS can, p.var_id = q.var_id AS same, p.var_id AS v, q.var_id AS w, p.lo AS la, p.hi AS ha, q.lo AS lb, q.hi AS hb FROM b p JOIN b q ON p.ra_id < q.ra_id)
SELECT a, b, can, CASE WHEN NOT can THEN 'IncompatibleIndicators' WHEN same THEN {_named('least(la, lb)', 'greatest(ha, hb)', 'v')} ELSE {_named('la', 'ha', 'v')} || chr(10) || {_named('lb', 'hb', 'w')} END AS name,
 CASE WHEN can THEN a::VARCHAR || ',' || b::VARCHAR END AS ras FROM t""")
def annotation_merge(spark, sf_dir):
    """Every pair of annotations merged: description and region, or the refusal."""
    _, made = _space(spark, sf_dir, True)
    rows = []
    for i, a in enumerate(made):
        for j, b in enumerate(made[i + 1 :], i + 1):
            try:
                m = annotate.merge_indicators(a, b)
                rows.append((i, j, a.can_merge_with(b), m.name, _ras(m)))
            except rules.IncompatibleIndicators as e:
                rows.append((i, j, a.can_merge_with(b), type(e).__name__, None))
    return small_table(spark, rows, "a int, b int, can boolean, name string, ras string")


@query(_sql(True) + """
SELECT 'variables' AS by, var_id::VARCHAR AS key, string_agg(ra_id::VARCHAR, ' ' ORDER BY ra_id) AS ras FROM b GROUP BY var_id
UNION ALL SELECT 'variables', '0,2', string_agg(p.ra_id || ',' || q.ra_id, ' ' ORDER BY p.ra_id) FROM b p JOIN b q ON q.ra_id = p.ra_id + 10
UNION ALL SELECT 'base', var_id::VARCHAR, string_agg(ra_id::VARCHAR, ' ' ORDER BY lo) FROM b GROUP BY var_id""")
def annotation_groups(spark, sf_dir):
    """Annotations by the variables of their descriptions, and by their base variable."""
    _, made = _space(spark, sf_dir, True)
    both = [annotate.merge_annotations([a, b]) for a, b in zip(made[:5], made[10:])]
    rows = [("variables", ",".join(map(str, k)), " ".join(map(_ras, v))) for k, v in annotate.by_variables(made + both).items()]
    rows += [("base", str(k), " ".join(map(_ras, v))) for k, v in annotate.by_base_variable(made[::-1]).items()]
    return small_table(spark, rows, "by string, key string, ras string")


@query(_sql() + """, x AS (SELECT * FROM (VALUES (0, 1), (0, 2), (0, 6), (1, 3), (1, 8)) v(root, leaf)) SELECT root::INT AS root, leaf::INT AS leaf, n FROM x JOIN n ON n.ra_id = leaf""")
def lineage_leaves(spark, sf_dir):
    """What annotations that were merged step by step were made from in the end."""
    space, made = _space(spark, sf_dir)
    one = annotate.merge_annotations([annotate.merge_annotations([made[1], made[6]]), made[2], annotate.merge_annotations([made[2]])])
    two = annotate.merge_annotations([made[8], annotate.merge_annotations([made[3], made[8]])])
    rows = [(k, int(_ras(leaf))) for k, a in enumerate((one, two)) for leaf in a.leaves()]
    return small_table(spark, rows, "root int, leaf int").join(sizes(space.inside(made)).withColumnRenamed("ra_id", "leaf"), "leaf")


def _components(nodes: str, edges: str, tag: str) -> str:
    """CTEs <tag>(id, c): the smallest node that every node is linked with."""
    return f"""{tag}u AS MATERIALIZED (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})),
{tag}r(id, c) AS (SELECT id, id FROM ({nodes}) UNION SELECT u.b, r.c FROM {tag}r r JOIN {tag}u u ON u.a = r.id WHERE u.b > r.c),
{tag} AS MATERIALIZED (SELECT id, min(c) AS c FROM {tag}r GROUP BY 1)"""


@query(_sql() + ", " + _components("SELECT ra_id AS id FROM b WHERE ra_id IN (0, 1, 3, 4)", "SELECT a, b FROM sh WHERE a IN (0, 1, 3, 4) AND b IN (0, 1, 3, 4)", "cc") + " SELECT c::INT AS part, string_agg(id::VARCHAR, ',' ORDER BY id) AS ras FROM cc GROUP BY 1")
def annotation_split(spark, sf_dir):
    """The connected parts of a region of four bands."""
    space, made = _space(spark, sf_dir)
    whole = annotate.Annotation(made[0].clauses, frozenset().union(*[made[i].pieces for i in (0, 1, 3, 4)]))
    return small_table(spark, [(min(p.pieces)[0], _ras(p)) for p in space.split(whole)], "part int, ras string")


def _merge_sql(share: float, rounds: int) -> str:
    """CTEs g0 .. g<rounds>(ra_id, g): which bands are merged after each round."""
    out = ["g0 AS MATERIALIZED (SELECT ra_id, ra_id AS g FROM b)"]
    for k in range(rounds):
        out += [
            f"in{k} AS MATERIALIZED (SELECT DISTINCT g, var_id, sample_id FROM inside JOIN g{k} USING (ra_id))",
            f"gn{k} AS MATERIALIZED (SELECT g, count(*) AS n FROM in{k} GROUP BY 1)",
            f"gb{k} AS MATERIALIZED (SELECT g, var_id, min(lo) AS lo, max(hi) AS hi FROM b JOIN g{k} USING (ra_id) GROUP BY ALL)",
            f"gs{k} AS MATERIALIZED (SELECT p.g AS a, q.g AS b, count(*) AS c FROM in{k} p JOIN in{k} q ON p.sample_id = q.sample_id AND p.var_id = q.var_id AND p.g < q.g GROUP BY ALL)",
            f"ge{k} AS MATERIALIZED (SELECT s.a, s.b FROM gs{k} s JOIN gn{k} x ON x.g = s.a JOIN gn{k} y ON y.g = s.b JOIN gb{k} p ON p.g = s.a JOIN gb{k} q ON q.g = s.b WHERE p.lo <= q.hi AND q.lo <= p.hi AND s.c / least(x.n, y.n) >= {share}::DOUBLE)",
            _components(f"SELECT DISTINCT g AS id FROM g{k}", f"SELECT a, b FROM ge{k}", f"gc{k}"),
            f"g{k + 1} AS MATERIALIZED (SELECT ra_id, c AS g FROM g{k} JOIN gc{k} ON gc{k}.id = g{k}.g)",
        ]
    return ", ".join(out)


_MERGED = f"""SELECT var_id AS panel, (row_number() OVER (PARTITION BY var_id ORDER BY lo) - 1)::INT AS pos, {_named()} AS name, ras, leaves, n FROM (
 SELECT g, min(var_id) AS var_id, min(lo) AS lo, max(hi) AS hi, string_agg(ra_id::VARCHAR, ',' ORDER BY ra_id) AS ras, count(*)::INT AS leaves FROM b JOIN %s USING (ra_id) GROUP BY g)
 LEFT JOIN (SELECT g, count(DISTINCT sample_id)::BIGINT AS n FROM inside JOIN %s USING (ra_id) GROUP BY 1) USING (g)"""


@query(_sql() + ", " + _merge_sql(0.7, 1) + " " + _MERGED.replace("%s", "g1"))
def merge_round(spark, sf_dir):
    """One round of merging within variables."""
    space, made = _space(spark, sf_dir)
    groups = annotate.merge_overfragmented(space, annotate.by_base_variable(made), 0.7, 1)
    return _panels(space, [groups[v] for v in sorted(groups)])


@query(_sql() + ", " + _merge_sql(0.64, 4) + " " + _MERGED.replace("%s", "g4"))
def merge_overfragmented_bands(spark, sf_dir):
    """Merging within variables until nothing is left to merge; four rounds are more than five bands need."""
    space, made = _space(spark, sf_dir)
    groups = annotate.merge_overfragmented(space, annotate.by_base_variable(made), 0.64)
    return _panels(space, [groups[v] for v in sorted(groups)])


# ---- panels


@query(_sql(True) + f""", al AS (SELECT a, b FROM pr WHERE c / (n_a + n_b - c + 1e-8::DOUBLE) > 0.95),
ne AS (SELECT a AS x, b AS y FROM al UNION ALL SELECT b, a FROM al),
vp AS (SELECT v.a, v.b FROM (VALUES (0, 1), (0, 2), (1, 2)) v(a, b) WHERE NOT EXISTS (SELECT 1 FROM b p WHERE p.var_id IN (v.a, v.b) AND (SELECT count(*) FROM ne JOIN b q ON q.ra_id = ne.y WHERE ne.x = p.ra_id AND q.var_id IN (v.a, v.b) AND q.var_id <> p.var_id) <> 1)
 AND NOT EXISTS (SELECT 1 FROM al JOIN b p ON p.ra_id = al.a JOIN b q ON q.ra_id = al.b WHERE p.var_id = q.var_id AND p.var_id IN (v.a, v.b))),
lk AS (SELECT al.a, al.b FROM al JOIN b p ON p.ra_id = al.a JOIN b q ON q.ra_id = al.b JOIN vp ON vp.a = least(p.var_id, q.var_id) AND vp.b = greatest(p.var_id, q.var_id)),
{_components("SELECT ra_id AS id FROM b", "SELECT a, b FROM lk", "mc")},
pn AS (SELECT c, string_agg(var_id::VARCHAR, ',' ORDER BY var_id) AS vars, string_agg({_named()}, chr(10) ORDER BY var_id) AS name, string_agg(ra_id::VARCHAR, ',' ORDER BY ra_id) AS ras, count(*)::INT AS leaves FROM b JOIN mc ON mc.id = b.ra_id GROUP BY 1)
SELECT (dense_rank() OVER (ORDER BY vars) - 1)::INT AS panel, (row_number() OVER (PARTITION BY vars ORDER BY c) - 1)::INT AS pos, name, ras, leaves, n.n::BIGINT AS n FROM pn JOIN n ON n.ra_id = pn.c""")
def contrastive_merge_bands(spark, sf_dir):
    """Variables whose regions match one to one become one panel."""
    space, made = _space(spark, sf_dir, True)
    return _panels(space, contrastive.merge_contrastive(space, made))


@query("SELECT 0::INT AS panel, -1.0::DOUBLE AS score")
def panel_score_single(spark, sf_dir):
    """A single candidate has nothing to be better than."""
    space, made = _space(spark, sf_dir)
    return small_table(spark, contrastive.panel_scores(space, [made[:5]]), "panel int, score double")


@query(_sql() + " SELECT ra_id::VARCHAR AS ras FROM pu WHERE n >= 50 AND purity >= 0.5")
def descriptive_filter(spark, sf_dir):
    space, made = _space(spark, sf_dir)
    return small_table(spark, [(_ras(a),) for a in descriptive.filter_annotations(space, made, 50, 0.5)], "ras string")


@query(_sql(True) + ", " + _components("SELECT ra_id AS id FROM b", "SELECT a, b FROM pr WHERE c / greatest(n_a, n_b) > 0.45::DOUBLE", "mc") + """,
gr AS (SELECT c, count(*)::INT AS leaves, string_agg(id::VARCHAR, ',' ORDER BY id) AS ras FROM mc GROUP BY 1),
gn AS (SELECT c, count(DISTINCT sample_id)::BIGINT AS n FROM inside JOIN mc ON mc.id = inside.ra_id GROUP BY 1)
SELECT (row_number() OVER (ORDER BY leaves DESC, c) - 1)::INT AS pos, ras, leaves, n FROM gr JOIN gn USING (c)""")
def descriptive_merge_bands(spark, sf_dir):
    """Regions that share enough of the larger one are described together."""
    space, made = _space(spark, sf_dir, True)
    return _panels(space, [descriptive.descriptive_merge(space, made, threshold=0.45)]).drop("panel", "name")


def _layout_sql(keep: str) -> str:
    """CTE bs(s): the best set of kept regions that share no sample."""
    scores = ("score_all_regions", "score_mean_occurrence", "score_perception", "score_purity", "score_coverage")
    weights = (30, 10, 10, 2, 10)
    ranks = ", ".join(f"s{i} AS MATERIALIZED ({_SCORES[name][1]}), k{i} AS (SELECT panel, count(*) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM s{i})" for i, name in enumerate(scores))
    total = " + ".join(f"k{i}.k * {w}" for i, w in enumerate(weights))
    return f"""kb AS MATERIALIZED (SELECT ra_id, var_id FROM b JOIN n USING (ra_id) {keep}),
al AS MATERIALIZED (SELECT a AS x, b AS y FROM sh UNION ALL SELECT b, a FROM sh),
cq(s, last) AS (SELECT [ra_id], ra_id FROM kb UNION ALL SELECT list_append(s, kb.ra_id), kb.ra_id FROM cq, kb WHERE kb.ra_id > last AND NOT EXISTS (SELECT 1 FROM al WHERE al.x = kb.ra_id AND list_contains(s, al.y))),
mx AS MATERIALIZED (SELECT s FROM cq WHERE NOT EXISTS (SELECT 1 FROM kb WHERE NOT list_contains(s, kb.ra_id) AND NOT EXISTS (SELECT 1 FROM al WHERE al.x = kb.ra_id AND list_contains(s, al.y)))),
st AS MATERIALIZED (SELECT row_number() OVER (ORDER BY len(s) DESC, s) - 1 AS panel, s FROM mx),
pa AS MATERIALIZED (SELECT panel, ra_id, var_id FROM (SELECT panel, unnest(s) AS ra_id FROM st) JOIN b USING (ra_id)),
vc AS (SELECT panel, var_id, count(*) AS n FROM pa GROUP BY ALL), pn AS (SELECT panel, count(*) AS n FROM pa GROUP BY 1),
{ranks},
bs AS MATERIALIZED (SELECT s FROM st {' '.join(f'JOIN k{i} USING (panel)' for i in range(len(scores)))} ORDER BY ({total}) DESC, panel LIMIT 1)"""


@query(_sql() + ", " + _layout_sql("") + f" SELECT 0::INT AS panel, (list_position(s, ra_id) - 1)::INT AS pos, {_named()} AS name, ra_id::VARCHAR AS ras, 1::INT AS leaves, n.n::BIGINT AS n FROM bs JOIN b ON list_contains(s, ra_id) JOIN n USING (ra_id)")
def descriptive_layout_bands(spark, sf_dir):
    """The best set of regions that do not overlap."""
    space, made = _space(spark, sf_dir)
    return _panels(space, descriptive.generate_layout(space, made, max_panels=1))


_COVERS = "SELECT a.ra_id, bg.ra_id AS background FROM %s a JOIN b bg ON a.var_id <> bg.var_id JOIN n ON n.ra_id = a.ra_id JOIN sh ON (sh.a = least(a.ra_id, bg.ra_id) AND sh.b = greatest(a.ra_id, bg.ra_id)) WHERE sh.c / n.n > 0.4"


def _backgrounds(spark, panels) -> DataFrame:
    rows = [(int(_ras(a)), int(i)) for p in panels for a in p for c in a.clauses for i in c.inds if str(i) != _ras(a)]
    return small_table(spark, rows, "ra_id int, background int")


@query(_sql() + " " + _COVERS % "b")
def background_enrichment(spark, sf_dir):
    """Descriptions of other variables' regions that cover enough of a region are added to its own."""
    space, made = _space(spark, sf_dir)
    return _backgrounds(spark, descriptive.enrich(space, [made[:5], made[5:]], made, 0.4))


@query(_sql() + ", " + _layout_sql("JOIN pu USING (ra_id) WHERE pu.purity >= 0.35 AND pu.n >= 5") + ", own AS (SELECT b.* FROM bs JOIN b ON list_contains(s, ra_id)) SELECT ra_id, ra_id AS background FROM own UNION ALL " + _COVERS % "own")
def descriptive_bands(spark, sf_dir):
    """Split, filter, merge, lay out and enrich: the best panel's regions, each beside itself, and what describes them too."""
    space, made = _space(spark, sf_dir)
    panels = descriptive.descriptive(space, made, max_panels=1, cluster_min_purity=0.35, background_enrichment_threshold=0.4)
    own = small_table(spark, [(int(_ras(a)), int(_ras(a))) for p in panels for a in p], "ra_id int, background int")
    return own.unionByName(_backgrounds(spark, panels))


# ---- regions with straight borders: x below a value, y below a value, both ends of x

#: A grid of 100 ticks, one apart; regions end where the customers' mean balance lies between their least and largest.
_TICKS = Grid(0.0, 0.0, 1.0, 1.0)
_CUTS = "c AS (SELECT (c_nationkey // 5)::BIGINT AS ind_id, (c_nationkey // 5) % 2 AS side, 20 + 40 * (avg(c_acctbal) - min(c_acctbal)) / (max(c_acctbal) - min(c_acctbal)) AS cut FROM customer GROUP BY 1, 2 HAVING count(*) > 1)"


def _half_planes(spark, sf_dir) -> DataFrame:
    """Cells of a region for every five nations: x (of even ones) or y (of odd ones) up to a cut between two ticks."""
    span = F.max("c_acctbal") - F.min("c_acctbal")
    cuts = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_nationkey") / 5).alias("ind_id")).agg((20 + 40 * (F.avg("c_acctbal") - F.min("c_acctbal")) / span).alias("cut"), F.count(F.lit(1)).alias("n")).where("n > 1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.arange(_TICKS.n, dtype=float)
        slope = 0.25 + (pdf["cut"].iloc[0] - g) / 200  # at the level on the cut
        z = np.repeat(slope[:, None], _TICKS.n, axis=1)
        return pd.DataFrame({"ind_id": pdf["ind_id"].iloc[0], **regions.cells_of(z if pdf["ind_id"].iloc[0] % 2 == 0 else z.T, 0.25)})

    return cuts.groupBy("ind_id").applyInPandas(run, regions.CELLS)


_PLANES = f"""WITH {_CUTS}, p AS (SELECT p.ind_id AS a, q.ind_id AS b, 99 * p.cut AS area_a, 99 * q.cut AS area_b, p.side = q.side AS same, p.cut AS ca, q.cut AS cb,
 CASE WHEN p.side = q.side THEN 99 * least(p.cut, q.cut) ELSE p.cut * q.cut END AS area FROM c p JOIN c q ON p.ind_id < q.ind_id)"""


@query(_PLANES + " SELECT a, b, round(area_a, 6) AS area_a, round(area_b, 6) AS area_b, round(area, 6) AS area, round(area / least(area_a, area_b), 6) AS intersection_percentage, round(area / (area_a + area_b - area), 6) AS iou, round(1 - area / (area_a + area_b - area), 6) AS iou_dist FROM p")
def area_iou_planes(spark, sf_dir):
    rows = geometry.area_metrics(geometry.intersection_areas(_half_planes(spark, sf_dir), _TICKS))
    return rows.select("a", "b", *[_round(c).alias(c) for c in ("area_a", "area_b", "area", "intersection_percentage", "iou", "iou_dist")])


@query(_PLANES + ", h AS (SELECT *, CASE WHEN same THEN 0 ELSE (99 - ca) * (99 - cb) / 2 END AS between_ FROM p) SELECT a, b, round(between_ / (between_ + area_a + area_b - area), 6) AS ratio FROM h")
def hull_ratio_planes(spark, sf_dir):
    cells = _half_planes(spark, sf_dir).persist()
    return geometry.hull_ratio(geometry.intersection_areas(cells, _TICKS), geometry.outlines(cells, _TICKS)).select("a", "b", _round("ratio").alias("ratio"))


@query(f"WITH {_CUTS} SELECT ind_id, 0::INT AS part_id, false AS hole, round(99 * cut, 4) AS area, round(CASE side WHEN 0 THEN cut / 2 ELSE 49.5 END, 4) AS x, round(CASE side WHEN 0 THEN 49.5 ELSE cut / 2 END, 4) AS y, (2 * ceil(cut) + 198)::INT AS n FROM c")
def region_outlines_planes(spark, sf_dir):
    """Outlines with their areas, points and centroids; a point stands wherever a border crosses a line of the grid."""
    cells = _half_planes(spark, sf_dir).persist()
    rings = geometry.outlines(cells, _TICKS)
    anchors = geometry.anchors(rings)
    return rings.select("ind_id", "part_id", "hole", _round("area", 4).alias("area"), F.size("points").alias("n")).join(anchors.select("ind_id", _round("x", 4).alias("x"), _round("y", 4).alias("y")), "ind_id")


def _two_ends(spark, sf_dir):
    """Samples and the cells of a region of two parts: of every label x outside of a middle stretch."""
    samples = embedded(spark, sf_dir).select("sample_id", "x", "y", F.col("label").cast("long").alias("label"))
    grid = Grid(-1.0, -1.0, 2 / 99, 2 / 99)
    labels_ = samples.groupBy("label").agg(F.avg("x").alias("m"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = -1 + np.arange(100) * grid.dx
        z = np.repeat((0.25 + (np.abs(g) - 0.05 - 0.005 * pdf["label"].iloc[0]))[:, None], 100, axis=1)
        return pd.DataFrame({"ind_id": pdf["label"].iloc[0], **regions.cells_of(z, 0.25)})

    return samples, grid, labels_.groupBy("label").applyInPandas(run, regions.CELLS)


_ENDS = f"WITH {_E}, l AS (SELECT DISTINCT label::BIGINT AS ind_id FROM e), t AS (SELECT ind_id, CASE WHEN x <= -0.05 - 0.005 * ind_id THEN 0 WHEN x >= 0.05 + 0.005 * ind_id THEN 1 END AS part_id, sample_id FROM e, l)"


@query(_ENDS + " SELECT ind_id, part_id::INT AS part_id, count(*)::BIGINT AS n FROM t WHERE part_id IS NOT NULL GROUP BY ALL")
def region_split(spark, sf_dir):
    """Parts of regions of two, and the samples in each."""
    samples, grid, cells = _two_ends(spark, sf_dir)
    return regions.samples_inside(samples, cells, grid).groupBy("ind_id", "part_id").agg(F.count(F.lit(1)).alias("n"))


@query(_ENDS + " SELECT ind_id, count(DISTINCT part_id)::BIGINT AS parts FROM t GROUP BY 1")
def region_parts_count(spark, sf_dir):
    samples, grid, cells = _two_ends(spark, sf_dir)
    return regions.samples_inside(samples, cells, grid).groupBy("ind_id").agg(F.count_distinct("part_id").alias("parts"))


_TURN = "(({b}.x - {a}.x) * (s.y - {a}.y) - ({b}.y - {a}.y) * (s.x - {a}.x))"
_TURNS = ", ".join(_TURN.format(a=a, b=b) for a, b in (("p", "q"), ("q", "r"), ("r", "p")))


@query(f"""WITH {_E}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS k FROM e) WHERE k <= 9),
tr AS (SELECT p.label, p AS p, q AS q, r AS r FROM m p JOIN m q ON p.label = q.label AND p.k < q.k JOIN m r ON r.label = q.label AND q.k < r.k)
SELECT tr.label::BIGINT AS ind_id, count(DISTINCT s.sample_id)::BIGINT AS n FROM tr, e s WHERE least({_TURNS}) >= -1e-12 OR greatest({_TURNS}) <= 1e-12 GROUP BY 1""")
def rangeset_hull(spark, sf_dir):
    """With no limit on the sides the triangles of nine members fill their hull: what lies in any triangle of three of them."""
    from pyspark.sql import Window as W

    e = embedded(spark, sf_dir).select("sample_id", "x", "y", F.col("label").cast("long").alias("ind_id"))
    members = e.withColumn("k", F.row_number().over(W.partitionBy("ind_id").orderBy("sample_id"))).where("k <= 9").select("ind_id", "x", "y")
    triangles = regions.triangulated(members, 10.0)
    return regions.inside_triangles(e.select("sample_id", "x", "y"), triangles, 0.05).groupBy("ind_id").agg(F.count_distinct("sample_id").alias("n"))


# ---- plot data and labels


@query(_sql() + """, t AS (SELECT 0 AS ra_id, 1 AS sub UNION ALL SELECT 0, 2 UNION ALL SELECT 0, 6 UNION ALL SELECT 1, 3 UNION ALL SELECT 1, 8)
SELECT t.ra_id::INT AS ra_id, (row_number() OVER (PARTITION BY t.ra_id ORDER BY sub) - 1)::INT AS pos, sub::VARCHAR AS ras, ['#a', '#b'][((row_number() OVER (PARTITION BY t.ra_id ORDER BY sub) - 1) % 2 + 1)::INT] AS color, n::BIGINT AS n FROM t JOIN n ON n.ra_id = sub""")
def subregions(spark, sf_dir):
    """The regions that annotations were made from, coloured in turn."""
    space, made = _space(spark, sf_dir)
    whole = [annotate.merge_annotations([made[1], made[2], made[6]]), annotate.merge_annotations([made[3], made[8]])]
    rows, parts = plotdata.subregions(whole, ["#a", "#b"])
    listed = small_table(spark, [(k, i, _ras(a), c, n) for n, ((k, i, c), a) in enumerate(zip(rows, parts))], "ra_id int, pos int, ras string, color string, part int")
    return listed.join(sizes(space.inside(parts)).withColumnRenamed("ra_id", "part"), "part").drop("part")


@query("""
WITH p AS (SELECT p_partkey, (p_size % 12) / 12.0::DOUBLE AS hue, p_size % 7 AS step FROM part), s AS (SELECT *, 0.2::DOUBLE + 0.8::DOUBLE * step / 6 AS sat FROM p),
k AS (SELECT *, list_transform([5, 3, 1], lambda n: 1 - sat * greatest(0, least(fmod(n + hue * 6, 6), 4 - fmod(n + hue * 6, 6), 1))) AS rgb FROM s)
SELECT p_partkey, round(rgb[1], 6) AS r, round(rgb[2], 6) AS g, round(rgb[3], 6) AS b, round(CASE WHEN hue > 1 - 1e-9 THEN 0 ELSE hue END, 6) AS hue FROM k""")
def hue_colors(spark, sf_dir):
    """Colours of one hue by saturation, and the hue told from the colour."""
    rgb = plotdata.hue_color((F.col("p_size") % 12) / 12.0, F.col("p_size") % 7, 7, 0.2)
    rows = table(spark, sf_dir, "part").select("p_partkey", rgb.alias("c"))
    return rows.select("p_partkey", _round("c.r").alias("r"), _round("c.g").alias("g"), _round("c.b").alias("b"), _round(plotdata.hue_of(F.col("c"))).alias("hue"))

