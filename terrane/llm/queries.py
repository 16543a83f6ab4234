"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.line_dedup import dedup_lines

    out = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.decontaminate import find_contamination

    return find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("spans")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.html_extract import extract_pages

    return extract_pages(_read(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.pii import digests, find_personal_data

    return digests(find_personal_data(_read(spark, sf_dir, "documents"), clean=True))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from terrane.llm.token_counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.embed_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.common import fold
    from terrane.llm.lm_score import score_texts

    return score_texts(_read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.common import fold
    from terrane.llm.langid import identify, train

    docs = _read(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    return identify(docs, train(docs.where(~held)), extra={"held_out": held})


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from terrane.llm.bpe import byte_bpe

    return byte_bpe(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


LINE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < r.last_doc, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT item_id, k, list_slice(w, p, p + k - 1) AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM s)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, p, k, list_slice(w, p, p + k - 1) AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
h AS (SELECT DISTINCT doc_id, p, k, item_id FROM dw JOIN win USING (k, win)),
q AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS at FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(q.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(q.n, 0) > 0 AS contaminated
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN i USING (doc_id)"""

_COMPONENTS = """
r(id, c) AS (SELECT id, id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id WHERE u.b > r.c),
g AS (SELECT id, min(c) AS component_id FROM r GROUP BY 1)"""

MINHASH_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, least(3, len(w)) AS k FROM w),
s AS (SELECT DISTINCT doc_id, list_slice(w, p, p + k - 1) AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM k WHERE k > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), n AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT g.id AS doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, component_id, g.id = component_id AS kept FROM g LEFT JOIN z ON z.doc_id = g.id"""

VECTOR_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), n AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
SELECT g.id AS vec_id, (SELECT count(*) FROM u WHERE u.a = g.id)::BIGINT AS n_links, component_id, g.id = component_id AS kept FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_SQL, "op2_decontaminate": CONTAMINATION_SQL, "op6_minhash": MINHASH_SQL, "op7_embedding": VECTOR_SQL}
