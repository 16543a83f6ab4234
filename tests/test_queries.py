"""Every query against its SQL on the smallest tables; those without SQL must give rows."""

import math

import duckdb
import pytest

from terrane import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in (r[c] for c in columns)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = core.queries()[name](spark, SF)
    got = plain([r.asDict() for r in df.collect()], sorted(df.columns))
    found = duck.execute(core.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == plain([dict(zip(names, r)) for r in found.fetchall()], sorted(names))


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_gives_rows(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["contrastive_fixed", "region_annotations_fixed"])
def test_fixed_plans_take_all_samples(spark, tmp_path, name):
    """More samples than the plans draw unless they are told to take all."""
    duckdb.execute(f"""COPY (SELECT t.k * 500 + vec_id AS vec_id, list_transform(embedding, lambda v: (v + t.k * 0.0011 * (1 + vec_id % 7))::FLOAT) AS embedding, label
        FROM '{SF}/embeddings.parquet', range(11) t(k)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    df = core.queries()[name](spark, str(tmp_path))
    found = con.execute(core.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert plain([r.asDict() for r in df.collect()], names) == plain([dict(zip(names, r)) for r in found.fetchall()], names)
