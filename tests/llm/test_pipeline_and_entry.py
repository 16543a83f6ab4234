import hashlib

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from terrane.llm import queries as llm

SF = "/root/testdata/sf0.001"


def test_names():
    assert [k.split("_")[0] for k in llm.queries()] == [f"op{i}" for i in range(1, 11)]
    assert {*llm.queries(), "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = sorted(tuple(r[c] for c in columns) for r in llm.queries()[name](spark, SF).collect())
    assert got == sorted(found.fetchall())


def test_pipeline_against_plain_versions(spark, tmp_path):
    import public_tokenizers
    import tiktoken
    from test_pair_operators import groups_brute
    from test_text_operators import contamination_brute, lines_brute

    from terrane.llm.bpe import load_merges

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "byte_bpe":
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(kept["language_id"]) >= first.count() - 3
    lines = lines_brute([(i, r["text"]) for i, r in kept["language_id"].items()])
    exp = {i: t for i, (n, gone, t) in lines.items() if not gone or (gone < n and t.strip(" "))}
    assert {i: r["text"] for i, r in kept["line_dedup"].items()} == exp
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"].values())
    near = groups_brute(sorted(exp.items()), 5, 80)
    assert set(kept["minhash_dedup"]) == {i for i, (_, c) in near.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in contamination_brute([(i, exp[i]) for i in kept["minhash_dedup"]], items) if x[5]}
    assert set(kept["decontaminate"]) == set(kept["minhash_dedup"]) - bad
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_merges(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    assert set(kept["byte_bpe"]) == set(kept["decontaminate"])
    for i, r in kept["byte_bpe"].items():
        assert r["ids"] == enc.encode_ordinary(exp[i]) and r["decoded_sha256"] == hashlib.sha256(exp[i].encode()).hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_no_rows(spark, odd_docs, no_docs, name):
    """Nulls in any column, repeated rows and columns of clashing names; no rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, odd_docs, SF)
    if name != "byte_bpe":
        assert found.columns == corpus_pipeline.COLUMNS
    rows = [r["doc_id"] for r in found.collect()]
    assert {7, None} <= set(rows)
    assert rows.count(4) == {"minhash_dedup": 1, "line_dedup": 0}.get(name, 2)  # its line is in document 5 too
    assert stage(spark, no_docs, SF).count() == 0


def test_rows_that_repeat_an_id(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, None), (1, text, "x"), (1, "another text of one id", None), (2, text, "y"), (None, text, "z"), (None, text, "z"), (3, None, None), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "lang AS source", "cast(1 AS bigint) AS n_chars")
    kept = corpus_pipeline.no_near_copies(spark, docs, SF).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept) == [(0, text), (0, text), (1, "another text of one id"), (1, text), (3, "")]
