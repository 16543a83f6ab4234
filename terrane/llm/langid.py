"""Language identification by interpolated Kneser-Ney character models.

A model holds, for all languages at once, the smoothed probabilities of the character n-grams it has seen
and the weights of their contexts in sorted hash arrays. Characters are read within runs of letters, blanks around
them; a text's language is the one with the lowest cross-entropy for each character.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.bpe import _Numbered
from terrane.llm.common import ids, map_texts, slices, small_batches, texts

ORDER = 4
#: Texts are looked at in slices of so many bytes: the costs of a slice's words take some hundred bytes for each character.
SLICE = 3 << 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
words_in = re.compile(r"[^\W\d_]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every character of every word and the blank behind it, the hash of itself after its context, by
    context length: a row each of 0 .. ORDER - 1 characters of context. Also the symbols of each word."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    pad = " " * (ORDER - 1)
    points = np.frombuffer((pad + (" " + pad).join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.repeat(np.arange(len(words)) * (ORDER - 1) + ORDER - 1, sizes) + np.arange(int(sizes.sum()))
    rows, code = [], np.zeros(len(at), np.uint64)
    for back in range(ORDER):
        code = (code + points[at - back] + np.uint64(1)) * _MIX
        code ^= code >> np.uint64(31)
        rows.append(code + np.uint64(back))
    return np.array(rows), sizes


def contexts(words: list[str]) -> np.ndarray:
    """The hash of the context alone, by its length."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    pad = " " * (ORDER - 1)
    points = np.frombuffer((pad + (" " + pad).join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.repeat(np.arange(len(words)) * (ORDER - 1) + ORDER - 1, sizes) + np.arange(int(sizes.sum()))
    rows, code = [np.zeros(len(at), np.uint64)], np.zeros(len(at), np.uint64)
    for back in range(1, ORDER):
        code = (code + points[at - back] + np.uint64(3)) * _MIX
        code ^= code >> np.uint64(29)
        rows.append(code)
    return np.array(rows)


@dataclass
class Model:
    """p[n]: (sorted hashes, probability by language); weight[n]: (sorted context hashes, weight by language)."""

    languages: list[str]
    p: list[tuple[np.ndarray, np.ndarray]]
    weight: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    temperature: float = 1.0
    cutoff: float = float("inf")

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats of every word in every language, and its symbols."""
        hashed, sizes = grams(words)
        context = contexts(words)
        _, first, inverse = np.unique(hashed[-1], return_index=True, return_inverse=True)
        p = np.full((len(first), len(self.languages)), self.floor)
        for n in range(ORDER):
            seen, values = _look(*self.p[n], hashed[n][first])
            has, weights = _look(*self.weight[n], context[n][first])
            p = p * np.where(has[:, None], weights, 1.0) + np.where(seen[:, None], values, 0.0)
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(-np.log(p)[inverse], starts, axis=0), sizes

    def entropies(self, docs: list[str]) -> np.ndarray:
        """Cross-entropy of every text in every language, in nats for each character."""
        number = _Numbered()
        own = [np.fromiter(map(number.__getitem__, found := words_in(d.lower())), np.int64, len(found)) for d in docs]
        out = np.zeros((len(docs), len(self.languages)))
        if number:
            costs, sizes = self.costs(list(number))
            for i, w in enumerate(own):
                if len(w):
                    out[i] = costs[w].sum(0) / sizes[w].sum()
        return out


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros((len(wanted), values.shape[1]))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def _fit(languages: list[str], table: dict[str, np.ndarray], discount: float) -> Model:
    """``table``: lang, size, gram, context, n, of the n-grams of the highest order and, with the number of
    different characters before them as n, of all lower ones."""
    p, weight = [], []
    place = {lang: i for i, lang in enumerate(languages)}
    column = np.array([place[x] for x in table["lang"]], np.int64)
    size, gram, context, n = (np.asarray(table[k]) for k in ("size", "gram", "context", "n"))
    gram, context = gram.astype(np.int64).view(np.uint64), context.astype(np.int64).view(np.uint64)
    for order in range(ORDER):
        own = size == order
        g, c, k, m = gram[own], context[own], column[own], n[own].astype(float)
        keys, at = np.unique(g, return_inverse=True)
        outer, to = np.unique(c, return_inverse=True)
        total, kinds = np.zeros((len(outer), len(languages))), np.zeros((len(outer), len(languages)))
        np.add.at(total, (to, k), m)
        np.add.at(kinds, (to, k), 1)
        share = np.zeros((len(keys), len(languages)))
        share[at, k] = np.maximum(m - discount, 0) / total[to, k]
        p.append((keys, share))
        weight.append((outer, np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)))
    return Model(languages, p, weight, 1 / 256)


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_chars: int = 4_000_000, calibration_docs: int = 1_000, discount: float = 0.75, total_chars: int = 64_000_000) -> Model:
    """Fit on a bounded sample of the rows with text and language: whole documents, dealt by the hash of their id
    to come to about ``sample_chars`` characters for each language, and as many as ``calibration_docs`` others. With
    many languages each has its share of ``total_chars``, which bounds the model."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("docs")).collect()  # a row for each language
    languages = sorted(r["lang"] for r in sums)
    if not languages:
        return Model([], [(np.zeros(0, np.uint64), np.zeros((0, 0)))] * ORDER, [(np.zeros(0, np.uint64), np.zeros((0, 0)))] * ORDER, 1 / 256)
    sample_chars = min(sample_chars, total_chars // len(languages))
    dealt = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    share, rest = F.lit(0.0), F.lit(0.0)
    for r in sums:
        part = min(0.9, sample_chars / max(1, r["chars"]))
        other = min(1.0, part + calibration_docs / r["docs"])
        share = F.when(F.col("lang") == r["lang"], F.lit(part)).otherwise(share)
        rest = F.when(F.col("lang") == r["lang"], F.lit(other)).otherwise(rest)
    sample = rows.withColumn("deal", dealt).withColumn("share", share).withColumn("rest", rest)

    def counter():
        held: dict[str, tuple[_Numbered, list]] = {}

        def work(batch: pa.RecordBatch):
            for lang, text in zip(batch.column(2).to_pylist(), texts(batch)):
                number, counts = held.setdefault(lang, (_Numbered(), []))
                for w in words_in(text.lower()):
                    i = number[w]
                    if i == len(counts):
                        counts.append(1)
                    else:
                        counts[i] += 1

        def finish():
            for lang, (number, counts) in held.items():
                if not number:
                    continue
                words = list(number)
                hashed, sizes = grams(words)
                context = contexts(words)
                n = np.repeat(np.array(counts, np.int64), sizes)
                _, first, inverse = np.unique(hashed[-1], return_index=True, return_inverse=True)
                total = np.bincount(inverse, n).astype(np.int64)
                columns = [hashed[k][first].view(np.int64) for k in range(ORDER)] + [context[k][first].view(np.int64) for k in range(ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), *map(pa.array, columns), pa.array(total)], ["lang", *[f"g{k}" for k in range(ORDER)], *[f"c{k}" for k in range(ORDER)], "n"])

        work.finish = finish  # type: ignore[attr-defined]
        return work

    names = [f"{a}{k}" for a in "gc" for k in range(ORDER)]
    found = map_texts(sample.where(F.col("deal") < F.col("share")), "id", "text", counter, "lang string, " + ", ".join(f"{x} bigint" for x in names) + ", n bigint", {"lang": F.col("lang")})
    found = found.groupBy("lang", *names).agg(F.sum("n").alias("n"))
    top = f"g{ORDER - 1}"
    table = found.toPandas()  # bounded by sample_chars
    parts: dict[str, list] = {k: [] for k in ("lang", "size", "gram", "context", "n")}
    for k in range(ORDER):
        if k == ORDER - 1:
            own = table.groupby(["lang", top, f"c{k}"], as_index=False)["n"].sum()
        else:
            own = table[["lang", f"g{k}", f"c{k}", f"g{k + 1}"]].drop_duplicates().groupby(["lang", f"g{k}", f"c{k}"], as_index=False).size().rename(columns={"size": "n"})
        parts["lang"].append(own["lang"].to_numpy())
        parts["size"].append(np.full(len(own), k))
        parts["gram"].append(own[f"g{k}"].to_numpy())
        parts["context"].append(own[f"c{k}"].to_numpy())
        parts["n"].append(own["n"].to_numpy())
    model = _fit(languages, {k: np.concatenate(v) for k, v in parts.items()}, discount)
    _calibrate(model, sample.where((F.col("deal") >= F.col("share")) & (F.col("deal") < F.col("rest"))))
    return model


def _calibrate(model: Model, held: DataFrame) -> None:
    """Temperature of the confidence and cutoff of the rejection from documents the counts have not seen."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def worker():
        def work(batch: pa.RecordBatch):
            h = shared.value.entropies(texts(batch))
            return pa.RecordBatch.from_arrays([batch.column(2), pa.array(list(h), pa.list_(pa.float64()))], ["lang", "h"])

        return work

    rows = map_texts(held, "id", "text", worker, "lang string, h array<double>", {"lang": F.col("lang")}, SLICE).collect()  # about calibration_docs a language
    rows = [r for r in rows if r["h"] and max(r["h"]) > 0]
    if not rows:
        return
    h = np.array([r["h"] for r in rows])
    true = np.array([model.languages.index(r["lang"]) for r in rows])
    losses = {}
    for t in (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
        z = -t * h
        losses[t] = float(np.mean(np.logaddexp.reduce(z, axis=1) - z[np.arange(len(z)), true]))
    model.temperature = min(losses, key=losses.get)
    best = h.min(1)
    middle, high = np.quantile(best, (0.5, 0.999))
    model.cutoff = float(max(high + 2 * (high - middle), 2 * middle))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Language of every whole text: id, extras, lang_pred, score (0 to 1), cross_entropy, rejected.

    ``und`` if the text is null or has no letter (or no language was learned), with score 0. ``rejected`` also
    marks texts that are less likely in their best language than calibration saw. Equal costs go to the first
    language by name. Repeated rows give a row each; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    extra = extra or {}
    names = list(extra)
    shared = df.sparkSession.sparkContext.broadcast(model)
    typed = df.select(*[c.alias(k) for k, c in extra.items()]).schema

    def worker():
        found = shared.value

        def work(batch: pa.RecordBatch):
            docs = texts(batch)
            lang, score, cost, rejected = [], [], [], []
            h = found.entropies(docs)
            for d, row in zip(docs, h):
                if not found.languages or not _LETTER.search(d):
                    lang.append(UNKNOWN), score.append(0.0), cost.append(None), rejected.append(True)
                    continue
                best = int(row.argmin())
                lang.append(found.languages[best])
                score.append(float(1.0 / np.exp(-found.temperature * (row - row[best])).sum()))
                cost.append(float(row[best]))
                rejected.append(bool(row[best] > found.cutoff))
            passed = [batch.column(batch.schema.get_field_index(k)) for k in names]
            return pa.RecordBatch.from_arrays([ids(batch), *passed, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cost, pa.float64()), pa.array(rejected, pa.bool_())], [id_col, *names, "lang_pred", "score", "cross_entropy", "rejected"])

        return work

    passed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in typed)
    return map_texts(df, id_col, text_col, worker, f"`{id_col}` {kind}, {passed}lang_pred string, score double, cross_entropy double, rejected boolean", extra, SLICE)


def identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose text is not rejected: texts that are null or have no letter go,
    and those less likely in their best language than the cutoff; all go if no language was learned. Every row is
    judged by its own text, so repeated rows stay or go together."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        found = shared.value
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                docs = [x or "" for x in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                kept = [bool(found.languages and _LETTER.search(d)) and row.min() <= found.cutoff for d, row in zip(docs, found.entropies(docs))]
                yield part.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)
