import hashlib
import html
import random
import re
import zlib
from collections import Counter
from math import log10

import pytest
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken

from pyspark.sql import functions as F

from terrane.llm import bpe
from terrane.llm.common import fold, fold_of
from terrane.llm.decontaminate import find_contamination
from terrane.llm.html_extract import extract_pages, main_text
from terrane.llm.langid import UNKNOWN, identified, identify, train
from terrane.llm.line_dedup import dedup_lines
from terrane.llm.lm_score import score_texts
from terrane.llm.pii import PATTERNS, digests, find_personal_data, generalise
from terrane.llm.token_counts import attribute, count_tokens, section_ends

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def lower(s):
    return s.encode().lower().decode()


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "i long").select("i", fold(F.col("i"), 5).alias("f")).collect()
    assert all(r["f"] == fold_of(r["i"], 5) for r in rows)
    assert fold_of(17, 5) == zlib.crc32(b"17") % 5


# ---- lines


def lines_brute(docs, min_chars=20, min_docs=3):
    strip = " \t\n\x0b\x0c\r"
    where = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = lower(line.strip(strip))
            if len(k) >= min_chars:
                where.setdefault(k, set()).add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(w := where.get(lower(x.strip(strip)), set())) >= min_docs and d < max(w))]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_against_brute_force(spark):
    r = random.Random(3)
    pool = [f"  Line number {i} of the SHARED pool é " for i in range(12)] + ["short", "", "x" * 20, "x" * 19, "Ünique " * 4]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(0, 9)))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h1", F.lit(1))
    for batch_docs, fanout in ((1000, 2), (9, 2), (15, 3), (4, 4)):
        got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["text"] or "") for x in dedup_lines(df, batch_docs=batch_docs, fanout=fanout).collect()}
        assert got == lines_brute(docs)
    assert dedup_lines(df).columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]


def test_lines_odd(odd_docs, no_docs):
    assert dedup_lines(odd_docs).count() == odd_docs.count()
    assert dedup_lines(no_docs).count() == 0


# ---- benchmark


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination_brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        for j in range(len(w) - min(window, len(w)) + 1) if w else ():
            wins.setdefault(tuple(w[j : j + min(window, len(w))]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(lower(t or "")), set(), set()
        for n in {len(k) for k in wins}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    found |= wins[tuple(w[j : j + n])]
        names = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_contamination_against_brute_force(spark, block_bytes):
    r = random.Random(7)
    words = ["alpha", "Beta", "gamma", "été", "delta9", "ε", "of", "the"]
    text = lambda n: r.choice([" ", ", "]).join(r.choice(words) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(14)] + [(14, None), (15, text(12)), (15, text(12))]
    docs = [(i, text(r.randrange(0, 40)) + " " + (r.choice(items)[1] or "") + "!" + text(r.randrange(0, 30))) for i in range(50)] + [(50, None), (51, ""), (51, ""), (None, text(30))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x)[:6] for x in find_contamination(d, b, block_bytes=block_bytes).collect()]
    assert sorted(got, key=repr) == contamination_brute(docs, items)


def test_contamination_odd(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    rows = find_contamination(odd_docs, b).collect()
    assert len(rows) == odd_docs.count() and sum(r["contaminated"] for r in rows) == 3
    assert find_contamination(no_docs, b).count() == 0
    assert find_contamination(odd_docs, b.limit(0)).where("contaminated").count() == 0


# ---- pages


def test_pages_of_the_tables(spark):
    for r in extract_pages(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav><a>Home</a></nav><article><h1>T</h1><p>One &amp; two&nbsp;three<p>Four</article><footer>f</footer>", "T\nOne & two three\nFour"),
        ("<body><div id='menu'>m</div><main><p>Text of the page</p><aside>side</aside><form>f<input></form><script>var a='<p>';</script></main>", "Text of the page"),
        ("<article><p>Body text here</p><section class='comments'><article><p>nice</p></article></section></article>", "Body text here"),
        ("<div class='cookie-notice'>We use</div><div><p>" + "Long paragraph of words. " * 8 + "</p><p>More of it.</p></div><div class='ad'>Buy</div>", ("Long paragraph of words. " * 8).strip() + "\nMore of it."),
        ("<article><ul><li>a<li>b <b>c</b></ul><table><tr><td>1<td>2</table></article>", "a\nb c\n1\n2"),
        ("", ""), ("<<<>>", "<<<>>"), ("plain words only", "plain words only"), ("<article>cut off <p>here <b>and", "cut off\nhere and"),
        ("<nav>n</nav>", ""), ("<header>h</header><article><header><h1>Title</h1></header><p>x</p><footer>by</footer></article>", "Title\nx"),
    ],
)
def test_page(page, text):
    assert main_text(page) == text


def test_pages_odd(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "", None), (3, "<p>" + "word " * 50_000, "u"), (3, "<p>x", "u"), (3, "<p>x", "u")], "page_id long, html string, url string").withColumn("text", F.lit("t"))
    rows = extract_pages(df).collect()
    assert [r["n_chars"] for r in rows] == [0, 0, 249_999, 1, 1] and rows[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert extract_pages(df.limit(0)).count() == 0 and "url" not in extract_pages(df.drop("url")).columns


# ---- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal_brute(text):
    def fine(k, v):
        d = re.sub("[^0-9]", "", v)
        if k == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if k == "card":
            return 14 <= len(d) <= 19 and sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
        return k == "email" or 10 <= len(d) <= 15

    found = sorted((m.start(), j, f"{k}:{m.start()}:{m.end()}") for j, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if fine(k, m[0]))
    return [x[2] for x in found]


def test_personal_data_against_brute_force(spark):
    r = random.Random(5)
    bits = ["a.b@c.de", "@", "x@y", "_q@w.e-f.g", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0255.1.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (212) 555-0153", "+49", "é🙂", " ", "-", "5", "00", "..", "+", "@b.c", "z@"]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randrange(0, 14)))) for i in range(400)] + [(400, None), (401, ""), (402, "9" * 3000 + "." + "a" * 3000 + "@"), (403, "1-" * 4000), (404, ("7" * 400 + ".") * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("x"))
    found = find_personal_data(df)
    shown = {x["doc_id"]: x for x in digests(found).collect()}
    assert len(shown) == len(docs)
    for d, t in docs:
        exp = personal_brute(t)
        assert [s for s in shown[d]["spans"].split(",") if s and not s.startswith("term")] == exp, t
        assert shown[d]["base_sha256"] == hashlib.sha256(",".join(exp).encode()).hexdigest()
        assert [shown[d][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in exp) for k in PATTERNS]


def test_disclosing_terms(spark):
    docs = [(i, f"Filler {i} and words{i} then Zorblax wrote ann@site.org about case{i} of the day") for i in range(6)] + [(10 + i, f"plain and the words of day then wrote about {i}") for i in range(200)] + [(300, "Only zorblax is named here"), (301, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in find_personal_data(df).join(df, "doc_id").select("*", generalise(F.coalesce("text", F.lit("")), F.col("spans")).alias("clean")).collect()}
    assert [s["kind"] for s in rows[300]["spans"]] == ["term"] and rows[300]["clean"] == "Only [TERM] is named here"
    assert "[EMAIL]" in rows[0]["clean"] and "Zorblax" not in rows[0]["clean"] and rows[0]["clean"].startswith("Filler 0 and words0 then")
    assert rows[10]["spans"] == [] and rows[10]["clean"] == "plain and the words of day then wrote about 0"
    whole = {r["doc_id"]: r for r in find_personal_data(df, clean=True).collect()}
    assert len(whole) == len(docs) and all(whole[i]["spans"] == rows[i]["spans"] and (whole[i]["text"] or "") == rows[i]["clean"] for i in rows)
    assert whole[301]["text"] is None and "clean_sha256" in digests(find_personal_data(df, clean=True)).columns


def test_many_terms_and_copies(spark, monkeypatch):
    """With patterns too large to be sent, with short terms, and with repeated rows the spans are the same."""
    from terrane.llm import pii

    docs = [(i % 40, f"李明 wrote zed{i % 8}@site{i % 8}.org again, number {i % 40} of all") for i in range(60)] + [(100 + i, f"nothing here {i}") for i in range(300)] + [(None, "李明 alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(map(str, digests(find_personal_data(df, clean=True)).collect()))
    monkeypatch.setattr(pii, "SENT_BYTES", 0)
    assert sorted(map(str, digests(find_personal_data(df, clean=True)).collect())) == one and len(one) == len(docs)


def test_personal_data_odd(odd_docs, no_docs):
    assert digests(find_personal_data(odd_docs)).count() == odd_docs.count()
    assert digests(find_personal_data(no_docs)).count() == 0


# ---- tokens


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_merges(RANKS).ranks, special_tokens={})


def test_replay_is_the_library(spark):
    r = random.Random(1)
    cases = ["", "a", "aaaaaaa" * 50, " " * 300, "x" * 20_000, "\n\n  \t", "é日本語🙂" * 30, "<|endoftext|>"] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF)])) for _ in range(r.randrange(1, 60))) for _ in range(500)]
    cases += ["".join(r.choice("abcdeABCDE   \n.,é日🙂0123") for _ in range(r.randrange(1, 200))) for _ in range(500)]
    merges, enc = bpe.load_merges(RANKS), encoding()
    for got, text in zip(bpe.encode_slice(merges, regex.compile(public_tokenizers.PATTERN), cases), cases):
        assert got.tolist() == enc.encode_ordinary(text)
        assert bpe.decode(merges, got) == text.encode()


def test_words_out_of_rank_order_are_encoded_alone():
    """A vocabulary in which a late merge makes an early pair possible."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"xa": 256, b"xabc": 257, b"bc": 258, b"ab": 259}
    merges = bpe.Merges(ranks)
    enc = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    words = [b"xabc", b"abc", b"xabcxabc", b"bcbc", b"xab", b"xabcbcxa"]
    tokens, counts = bpe.replay(merges, words)
    at = 0
    for w, n in zip(words, counts.tolist()):
        assert tokens[at : at + n].tolist() == enc.encode_ordinary(w.decode()) == bpe.encode_one(merges, w)
        at += n


def test_bpe_odd(odd_docs, no_docs):
    rows = bpe.byte_bpe(odd_docs, RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    assert [bytes(r["decoded"]).decode() for r in rows] == texts
    assert rows[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and rows[0]["n_tokens"] == 0
    assert bpe.byte_bpe(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("rule", ["majority", "first", "last"])
def test_attribution_against_brute_force(rule):
    r = random.Random(2)
    for _ in range(300):
        data = bytes(r.choice(b"ab\n") for _ in range(r.randrange(1, 40)))
        sections = section_ends(data, b"\n")
        ends, at = [], 0
        while at < len(data):
            at = min(len(data), at + r.randrange(1, 7))
            ends.append(at)
        import numpy as np

        owner, crossing = attribute(np.array(ends), sections, rule)
        of = [int(np.searchsorted(sections, i, side="right")) for i in range(len(data))]
        for k, (s, e) in enumerate(zip([0, *ends], ends)):
            own = of[s:e]
            exp = own[0] if rule == "first" else own[-1] if rule == "last" else min(set(own), key=lambda x: (-own.count(x), x))
            assert owner[k] == exp and crossing[k] == (len(set(own)) > 1)


def test_token_counts(odd_docs, no_docs):
    enc = encoding()
    rows = count_tokens(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    for r, d in zip(rows, odd_docs.collect()):
        assert r["n_tokens"] == len(enc.encode_ordinary(d["text"] or "")) == sum(r["section_tokens"]) and r["n_sections"] == len(r["section_tokens"])
    assert count_tokens(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        count_tokens(odd_docs, RANKS, public_tokenizers.PATTERN, rule="all")


# ---- language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = fold(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held))
    rows = identify(docs, model, extra={"held_out": held}).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in own) / len(own) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 5


def test_language_odd(spark, odd_docs, no_docs):
    model = train(odd_docs)
    rows = identify(odd_docs, model).collect()
    assert [r["lang_pred"] == UNKNOWN for r in rows] == [not re.search(r"[^\W\d_]", d["text"] or "") for d in odd_docs.collect()]
    kept = identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.where("text IS NULL").count() == 0
    assert identify(no_docs, model).count() == 0
    none = train(no_docs)
    assert none.languages == [] and {r["lang_pred"] for r in identify(odd_docs, none).collect()} == {UNKNOWN}


def test_texts_unlike_every_language_are_rejected(spark):
    r = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs)
    strange = [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxzqjx") for _ in range(r.randrange(2, 9))) for _ in range(60)), "Все люди рождаются свободными и равными в своем достоинстве", "人人生而自由在尊严和权利上一律平等", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności"]
    rows = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    assert [x["rejected"] for x in identify(rows, model).collect()] == [True] * len(strange)
    assert identified(rows, model).count() == 0 and identified(docs, model).count() >= docs.count() - 3


def kneser_ney(train_docs, discount=0.75, order=4, floor=1 / 256):
    """Interpolated Kneser-Ney over dictionaries: language -> (character, context) -> probability."""
    from collections import defaultdict
    from functools import partial

    out = {}
    for lang in {x for x, _ in train_docs}:
        counts = [defaultdict(lambda: defaultdict(int)) for _ in range(order)]
        before = [defaultdict(set) for _ in range(order)]
        for own, text in train_docs:
            for w in re.findall(r"[^\W\d_]+", text.lower()) if own == lang else ():
                line = " " * (order - 1) + w + " "
                for i in range(order - 1, len(line)):
                    counts[order - 1][line[i - order + 1 : i]][line[i]] += 1
                    for k in range(order - 1):
                        before[k][(line[i - k : i], line[i])].add(line[i - k - 1 : i])
        for k in range(order - 1):
            for (context, c), seen in before[k].items():
                counts[k][context][c] = len(seen)

        def p(c, context, counts):
            if context is None:
                return floor
            own = counts[len(context)].get(context)
            lower = p(c, context[1:] if context else None, counts)
            if not own:
                return lower
            total = sum(own.values())
            return max(own.get(c, 0) - discount, 0) / total + discount * len(own) / total * lower

        out[lang] = partial(p, counts=counts)
    return out


def test_language_model_against_plain_kneser_ney(spark):
    from math import log

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", "lang").persist()
    model = train(docs, sample_chars=10**9, calibration_docs=1)
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    plain = kneser_ney([(r["lang"], r["text"]) for r in docs.where(dealt < 0.9).collect() if r["text"]])
    for text in ("the words of a text", "Nicht aulich für sch erüver", "zzz qxqx", "ñ"):
        own = model.entropies([text])[0]
        for lang, p in plain.items():
            lines = ["   " + w + " " for w in re.findall(r"[^\W\d_]+", text.lower())]
            costs = [-log(p(x[i], x[i - 3 : i])) for x in lines for i in range(3, len(x))]
            assert own[model.languages.index(lang)] == pytest.approx(sum(costs) / len(costs), rel=1e-9)


# ---- language model


def test_scores_against_counts(spark, odd_docs, no_docs):
    held = fold(F.col("doc_id"), 5) == 1
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for common in (3, 1000):
        rows = score_texts(odd_docs, held, common=common, density=0.01 if common == 3 else 400.0).collect()
        words = {i: (t or "").encode().lower().split() + [None] for i, t in docs}
        counts = Counter(w for i, t in docs if fold_of(i, 5) != 1 for w in (t or "").encode().lower().split() + [None])
        n, v = sum(counts.values()), len(counts)
        assert len(rows) == len(docs)
        for r in rows:
            own = words[r["doc_id"]]
            assert r["train_tokens"] == n and r["n_tokens"] == len(own) and r["n_known"] == sum(counts[w] > 0 for w in own)
            assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
            assert r["score"] < 0 and r["held_out"] == (fold_of(r["doc_id"], 5) == 1)
    assert score_texts(no_docs, held).count() == 0


def toy_counts(words: dict[str, int], least: int, ends: int = 50):
    """(vocabulary, its words) when words of fewer than ``least`` occurrences have no entry of their own."""
    import numpy as np
    import xxhash

    from terrane.llm.lm_score import GROUPS, Vocabulary, _signed, groups_of

    h = np.array([_signed(xxhash.xxh64_intdigest(w.encode())) for w in words], np.int64)
    g = groups_of(pa.array([w.encode() for w in words], pa.binary()))
    c = np.array(list(words.values()))
    rest = c < least
    return Vocabulary(h[~rest], g[~rest], c[~rest].astype(float), np.bincount(g[rest], c[rest], GROUPS), np.bincount(g[rest], minlength=GROUPS).astype(float), ends)


def plain_log_p(model, one: int, two: int, entry: int) -> float:
    """log10 of the softmax over the groups times the softmax over the entries of the group, one product at a time."""
    from math import exp

    words = model.words
    q = [model.r[one][j] * model.c[0][j] + model.r[two][j] * model.c[1][j] for j in range(model.size)] + [1.0]
    dot = lambda v: sum(float(a) * float(b) for a, b in zip(q, v))
    g = int(words.group[entry])
    groups = [exp(dot(v)) for v in model.u]
    members = {i: exp(dot(model.e[i])) for i in range(len(model.e)) if words.group[i] == g}
    return log10(groups[g] / sum(groups) * members[entry] / sum(members.values()))


def test_model_is_normalised_and_learns(spark):
    import numpy as np

    from terrane.llm.lm_score import LogBilinear, Trainer

    r = np.random.default_rng(0)
    words = toy_counts({f"{a}xyz" if a % 2 else f"{a}w": 10 + a for a in range(24)}, 12)
    every = np.arange(len(words.group))
    model = LogBilinear(words, 8)
    some = every[words.size[words.group] > 1][:10]
    assert len(some) == 10 and abs(np.exp(model.log_p(np.full(len(every), 3), np.full(len(every), 5), every)).sum() - 1) < 1e-4
    one, two = r.choice(some, 40_000), r.choice(some, 40_000)
    word = some[(np.searchsorted(some, one) + 1) % len(some)]  # the next word follows from the last one
    before = model.log_p(one, two, word).mean()
    trainer = Trainer(model, batch=256)
    for _ in range(3):
        trainer.learn(one, two, word)
    assert model.log_p(one, two, word).mean() > before + 0.5
    assert abs(np.exp(model.log_p(np.full(len(every), 3), np.full(len(every), 5), every)).sum() - 1) < 1e-4
    for a, b, c in zip(one[:5], two[:5], word[:5]):
        assert model.log_p(np.array([a]), np.array([b]), np.array([c]))[0] / np.log(10) == pytest.approx(plain_log_p(model, a, b, c), abs=1e-4)


def test_tokens_are_those_of_plain_splitting():
    from terrane.llm.lm_score import Tokens, _signed, xxhash

    docs = ["  Ab\tCD ab\x0b", None, "", " \n", "\u00c9t\u00e9 \u00a0x\u2003y AB", "one\r\ntwo\x0cTHREE\x1cfour"]
    t = Tokens(pa.array(docs, pa.string()))
    words = [w for d in docs for w in [*(d or "").encode().lower().split(), None]]
    assert [None if i < 0 else int(t.hashes[i]) for i in t.flat] == [None if w is None else _signed(xxhash.xxh64_intdigest(w)) for w in words]
    assert t.sizes.sum() == len(words) and len(t.hashes) == len(t.groups) == len(set(words) - {None}) and Tokens(pa.array(docs, pa.string())[2:4]).flat.tolist() == [-1, -1]


def test_tasks_draw_different_noise():
    from terrane.llm.lm_score import LogBilinear, Trainer

    model = LogBilinear(toy_counts({"a": 5}, 1), 4)
    assert Trainer(model, seed=1).draw.random() != Trainer(model, seed=2).draw.random()


@pytest.mark.parametrize(("density", "common"), [(400.0, 1000), (10.0, 1000), (10.0, 3), (1e-3, 3)])
def test_scores_against_the_plain_model(spark, density, common, monkeypatch):
    """Scores by the model's vectors, one token at a time, whatever words have entries and whatever counts are joined."""
    from terrane.llm import lm_score

    models = []
    train = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    docs = [(i, " ".join(f"w{(i * j * j) % 31}{'abc'[j % 3]}" for j in range(i % 25)) + (" never" if i % 5 == 0 else "")) for i in range(60)]
    rows = score_texts(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 5 == 0, density=density, common=common).collect()
    counts = Counter(w for i, t in docs if i % 5 for w in t.split())
    words = models[0].words
    own = {int(k): int(e) for k, e in zip(words.keys, words.entry)}
    for r in rows:
        one = two = words.end
        total = 0.0
        for w in [*dict(docs)[r["doc_id"]].split(), None]:
            g = lm_score.GROUPS if w is None else int(lm_score.groups_of(pa.array([w.encode()], pa.binary()))[0])
            entry = words.end if w is None else own.get(lm_score._signed(lm_score.xxhash.xxh64_intdigest(w.encode())), int(words.start[g]))
            total += plain_log_p(models[0], one, two, entry)
            if w is not None and entry == words.start[g]:
                others = [c for v, c in counts.items() if int(lm_score.groups_of(pa.array([v.encode()], pa.binary()))[0]) == g and lm_score._signed(lm_score.xxhash.xxh64_intdigest(v.encode())) not in own]
                total += log10((counts[w] + 0.5) / (sum(others) + 0.5 * (len(others) + 1)))
            one, two = entry, one
        assert r["score"] == pytest.approx(total, rel=1e-4)


def test_vocabulary_grows_with_the_corpus(spark):
    from terrane.llm.lm_score import summarise

    sizes = []
    for times in (1, 8):  # as many tokens of as many words each
        counts = spark.range(200_000).selectExpr("id AS h", "cast(id % 256 AS int) AS g", f"cast({times} * 400000 / (id + 10) AS bigint) AS c").where("c > 0")
        found = summarise(counts, 1000, 40.0)
        n = found.n ** (2 / 3) / 40
        assert len(found.words.keys) == counts.where(f"c >= greatest(3, {n})").count() <= 40 * found.n ** (1 / 3)
        sizes.append(len(found.words.keys))
    assert sizes[1] > 1.5 * sizes[0]


def test_held_out_texts_are_likelier_than_by_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = score_texts(docs, fold(F.col("doc_id"), 5) == 1).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_neural_model_learns_from_every_position(spark):
    """As many positions are learned from as training has tokens and ends, whatever the number of rounds."""
    from terrane.llm.lm_score import count_words, summarise, train

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 40))) for i in range(150)], "doc_id long, text string").repartition(3)
    counts = summarise(count_words(docs, "doc_id", "text"), 1000, 16.0)
    for rounds in (1, 2):
        assert train(docs, counts, "doc_id", "text", rounds).tokens == counts.n == sum(i % 40 + 1 for i in range(150))
