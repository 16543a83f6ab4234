"""Personal data and the terms that give it away, with DataFrame functions only.

Fixed patterns find emails, addresses, card and phone numbers. Their values are the protected entities.
For every term that stands near an entity, the corpus tells how strongly the term reveals it: the share of
the term's documents that hold the entity, and the bits by which that exceeds the entity's own share. Terms
above the thresholds are found in every document; they and the entities can then be generalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.common import ascii_lower, materialize, parted

#: Fixed patterns, with possessive parts where nothing can be given back and a start that no longer run
#: of the same characters precedes, so that long runs cost no more than their length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
KINDS = [*PATTERNS, "term"]
TERM = r"[\p{L}\p{N}]++"
SPANS = "array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>"
#: Patterns of so many bytes in all are broadcast, more are shuffled.
SENT_BYTES = 32 << 20


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits holds."""
    n = F.length(digits)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, twice(F.substring(digits, i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    parts = F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    return F.when(kind == "ip", parts).when(kind == "card", F.when(n.between(14, 19), luhn(digits)).otherwise(False)).when(kind == "phone", n.between(10, 15)).otherwise(True)


def matches(text: Column, pattern: Column, reach: int) -> Column:
    """Leftmost matches without overlap: gap before each, its value and what stands around it."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    around = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.struct(F.length(F.element_at(pieces, i)).alias("gap"), F.element_at(found, i).alias("value"), F.right(F.element_at(pieces, i), F.lit(reach)).alias("before"), F.left(F.element_at(pieces, i + 1), F.lit(reach)).alias("after")))
    return F.when(F.size(found) > 0, around)


def _placed(found: DataFrame) -> DataFrame:
    """doc, version, kind, pos, m -> the same with start and end; rows of equal document count once."""
    one = found.groupBy("doc", "version", "kind", "pos").agg(F.first("m").alias("m")).select("doc", "version", "kind", "pos", "m.*")
    before = W.partitionBy("doc", "version", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    return one.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))


def base_spans(rows: DataFrame, reach: int) -> DataFrame:
    """Valid matches in (doc, version, text): doc, version, kind, value, start, end, before, after."""

    def tried(kind: str, pattern: str) -> Column:
        holds = F.contains("text", F.lit(NEEDS[kind])) & (F.lit(kind == "email") | F.col("text").rlike("[0-9]"))
        return F.when(holds, F.transform(matches(F.col("text"), F.lit(pattern), reach), lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), m.alias("m"))))

    found = rows.select("doc", "version", F.array_compact(F.array(*[tried(k, p) for k, p in PATTERNS.items()])).alias("all")).where(F.size("all") > 0)
    found = found.select("doc", "version", F.explode(F.flatten("all")).alias("x")).select("doc", "version", "x.kind", "x.pos", "x.m")
    return _placed(found).where(valid(F.col("kind"), F.col("value")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0)))


def _holding(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, version, term) for the documents that hold one of the terms: one pass over the texts, whatever the number of
    terms. Words in whose hash bucket no term is are left out before they are shuffled."""
    held = rows.select("doc", "version", F.explode(_terms(F.col("text"))).alias("term"))
    maybe, _ = parted(held, [F.col("term")], terms, [F.col("term")])
    return maybe.join(terms, "term")


def disclosing_terms(rows: DataFrame, spans: DataFrame, min_contexts: int = 3, min_share: float = 0.5, min_bits: float = 4.0) -> DataFrame:
    """Terms that reveal an entity: term, entity, n_contexts, share, bits.

    share: documents of the term that hold the entity near it, of all documents of the term; bits: log2 of that over the
    entity's share of all documents. Contexts are told apart by their text, so copies of a document do not add up.
    """
    entity = F.concat_ws(":", "kind", "value")
    seen = spans.select("doc", "version", entity.alias("entity"), F.concat_ws(" ", "before", "after").alias("context"))
    # a term cut off by the end of the context is not taken
    near = seen.select("doc", "version", "entity", F.xxhash64("context").alias("context"), F.explode(_terms(F.regexp_replace("context", r"^[\p{L}\p{N}]+|[\p{L}\p{N}]+$", " "))).alias("term"))
    contexts = near.groupBy("entity", "term", "context").count().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_contexts")).where(F.col("n_contexts") >= min_contexts)
    both = near.groupBy("entity", "term", "doc", "version").count().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    # the term stands in all these documents at least: what has too small a share of them need not be looked for elsewhere
    near_any = near.groupBy("term", "doc", "version").count().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    pairs = contexts.join(both, ["entity", "term"]).join(near_any, "term").where(F.col("n_both") >= min_share * F.col("n_near"))
    pairs = materialize(pairs.drop("n_near"), "pairs")
    known = materialize(pairs.select("term").distinct(), "terms")
    total = rows.count()
    df = _holding(rows, known).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    own = seen.groupBy("entity").agg(F.countDistinct("doc", "version").alias("n_entity"))
    share = F.col("n_both") / F.col("n_term")
    bits = F.log2(share / (F.col("n_entity") / F.lit(float(max(total, 1)))))
    told = pairs.join(df, "term").join(own, "entity").withColumns({"share": share, "bits": bits})
    return told.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits)).select("term", "entity", "n_contexts", "share", "bits")


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 80, min_contexts: int = 3, min_share: float = 0.5, min_bits: float = 4.0, clean: bool = False) -> DataFrame:
    """Spans of personal data of every row: id, version (hash of the text) and
    spans array<struct<start, rank, kind, end>> in code points, by start, then kind; with ``clean`` also text, in which
    the spans are generalised.

    Base kinds are email, ip, card and phone; ``term`` marks terms that reveal one of them. A term stands near an entity
    if it is within ``reach`` code points of it. A null or empty text has no spans (and stays as it is). Every row is
    returned, repeated ones too; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("whole"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    base = materialize(base_spans(rows, reach), "spans")
    told = materialize(disclosing_terms(rows, base, min_contexts, min_share, min_bits).select("term").distinct(), "terms")
    spans = base.select("doc", "version", "kind", "start", "end")
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
    if told.limit(1).count():
        named = _holding(rows, told).groupBy("doc", "version").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("any"))
        named = named.select(F.col("doc").alias("d"), F.col("version").alias("v"), F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])(?:"), "any", F.lit(r")(?![\p{L}\p{N}])")).alias("pattern"))
        named = materialize(named, "named")
        if (named.agg(F.sum(F.octet_length("pattern") + 64)).first()[0] or 0) <= SENT_BYTES:
            found = rows.join(F.broadcast(named), same)
        else:  # both sides are shuffled, of the texts only those that may hold a term
            found = parted(rows, [F.col("doc"), F.col("version")], named, [F.col("d"), F.col("v")])[0].join(named, same)
        found = found.select("doc", "version", F.lit("term").alias("kind"), F.posexplode(matches(F.col("text"), F.col("pattern"), 0)).alias("pos", "m"))
        spans = spans.unionByName(_placed(found).select("doc", "version", "kind", "start", "end"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = spans.groupBy("doc", "version").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans")).select(F.col("doc").alias("d"), F.col("version").alias("v"), "spans")
    spans = materialize(spans, "document-spans")
    # only documents that may have spans are shuffled
    some, none = parted(rows if clean else rows.select("doc", "version"), [F.col("doc"), F.col("version")], spans, [F.col("d"), F.col("v")])
    empty = F.array().cast(SPANS)
    some = some.join(spans, same, "left").withColumn("spans", F.coalesce("spans", empty))
    none = none.withColumn("spans", empty)
    columns = [F.col("doc").alias(id_col), "version", "spans"]
    if not clean:
        return some.select(*columns).unionByName(none.select(*columns))
    cleaned = F.when(F.size("spans") > 0, generalise(F.col("text"), F.col("spans"))).otherwise(F.col("whole"))
    return some.select(*columns, cleaned.alias("text")).unionByName(none.select(*columns, F.col("whole").alias("text")))


def generalise(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one counts."""
    kept = F.aggregate(spans, F.array().cast(SPANS), lambda done, s: F.when((F.size(done) == 0) | (F.element_at(done, -1)["end"] <= s["start"]), F.concat(done, F.array(s))).otherwise(done))
    last = F.struct(F.length(text).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("kind"), F.length(text).cast("bigint").alias("end"))
    cuts = F.concat(kept, F.array(last))
    piece = lambda i: F.concat(
        F.substring(text, F.when(i > 1, F.element_at(cuts, F.greatest(i - 1, F.lit(1)))["end"]).otherwise(0).cast("int") + 1, (F.element_at(cuts, i)["start"] - F.when(i > 1, F.element_at(cuts, F.greatest(i - 1, F.lit(1)))["end"]).otherwise(0)).cast("int")),
        F.when(F.element_at(cuts, i)["kind"] != "", F.concat(F.lit("["), F.upper(F.element_at(cuts, i)["kind"]), F.lit("]"))).otherwise(""),
    )
    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(cuts)), piece), "")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and list of the spans of ``find_personal_data``, and the digest of the text if that is there."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    clean = [F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256")] if "text" in found.columns else []
    return found.select(id_col, *[count(k) for k in PATTERNS], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), count("term"), *clean)
