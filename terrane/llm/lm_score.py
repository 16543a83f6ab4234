"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

Counts of all training tokens are made first. Words are grouped by ending and length, so that any word, seen or
not, has a group. The words that occur often enough for the size of the corpus have entries of their own in
their group; all others of a group are its rest entry, times the word's own share of the rest. The model
predicts a vector from the vectors of the two entries before a token and from that the token's group and
then the entry within the group, so a normalised probability takes the products with all groups and with the
entries of one group, never with the whole vocabulary. It is trained in numpy in every task on the task's own
training documents, for groups against noise groups and for entries against noise entries of the group, and
the tasks' vectors are averaged; another round goes on from there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import ids, map_texts, materialize

#: Groups of words by their last bytes and by whether they are long; the end of a text is a group of its own behind them.
GROUPS, ENDING, LONG = 256, 2, 6
#: No word holds a blank, so this is never one.
END_HASH = xxhash.xxh64_intdigest(b"\n")
SLICE = 4 << 20
#: Words that a task holds counts of, about.
FLUSH = 800_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _layout(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """Ends of the words of a binary array without nulls, and their bytes."""
    return np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64), bytes(words.buffers()[2] or b"")


def hashes_of(words: pa.Array) -> np.ndarray:
    ends, data = _layout(words)
    at = ends.tolist()
    return np.fromiter((xxhash.xxh64_intdigest(data[i:j]) for i, j in zip(at, at[1:])), np.uint64, len(words)).view(np.int64)


def groups_of(words: pa.Array) -> np.ndarray:
    """The group of every word of a binary array without nulls."""
    ends, data = _layout(words)
    size = np.diff(ends)
    data = np.frombuffer(data, np.uint8)
    ending = np.zeros(len(words), np.uint64)
    for back in range(1, ENDING + 1):
        has = np.flatnonzero(size >= back)
        ending[has] = ending[has] * np.uint64(256) + data[ends[1:][has] - back]
    mixed = (ending * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return ((mixed + np.where(size > LONG, np.uint64(GROUPS // 2), np.uint64(0))) % np.uint64(GROUPS)).astype(np.int64)


class Tokens:
    """Words of a slice of texts: flat word numbers with an end (-1) behind each text, the words' hashes and groups."""

    def __init__(self, docs: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(docs, "")))
        doc = np.repeat(np.arange(len(docs)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        words = split.flatten()
        full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # blanks at the ends leave empty ones
        if not full.all():
            words, doc = words.filter(pa.array(full)), doc[full]
        found = words.dictionary_encode()
        self.sizes = np.bincount(doc, minlength=len(docs)).astype(np.int64) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.full(int(self.sizes.sum()), -1)
        inner = np.ones(len(self.flat), bool)
        inner[self.starts + self.sizes - 1] = False
        self.flat[inner] = found.indices.to_numpy()
        distinct = found.dictionary.cast(pa.binary())
        self.hashes = hashes_of(distinct)
        self.groups = groups_of(distinct)
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)

    def find(self, keys: np.ndarray, values: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """Value of every distinct word from sorted keys."""
        if not len(keys) or not len(self.hashes):
            return missing
        at = np.minimum(np.searchsorted(keys, self.hashes), len(keys) - 1)
        return np.where(keys[at] == self.hashes, values[at], missing)

    def entries(self, words: Vocabulary) -> np.ndarray:
        """The entry of every token."""
        return np.append(self.find(words.keys, words.entry, words.start[self.groups]), words.end)[self.flat]

    def contexts(self, entries: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The two entries before every token; an end before the first one."""
        one, two = np.full(len(entries), end), np.full(len(entries), end)
        one[1:], two[2:] = entries[:-1], entries[:-2]
        one[self.starts] = end
        two[self.starts] = end
        second = (self.starts + 1)[self.sizes > 1]
        two[second] = end
        return one, two


class Vocabulary:
    """Entries in the order of their groups, the rest of a group before its words, and their shares of the training tokens."""

    def __init__(self, hashes: np.ndarray, groups: np.ndarray, counts: np.ndarray, rest_n: np.ndarray, rest_kinds: np.ndarray, ends: int):
        """The words with entries; tokens and distinct words of every group beside them; how many texts end."""
        order = np.lexsort((hashes, groups))
        hashes, groups, counts = hashes[order], groups[order], counts[order]
        self.start = np.searchsorted(groups, np.arange(GROUPS + 1)) + np.arange(GROUPS + 1)
        self.end = int(self.start[-1])
        self.size = np.diff(np.append(self.start, self.end + 1))
        self.group = np.repeat(np.arange(GROUPS + 1), self.size)
        entry = np.arange(len(groups)) + groups + 1
        n = np.zeros(self.end + 1)
        n[entry], n[self.start[:-1]], n[self.end] = counts, rest_n, ends
        total = np.bincount(self.group, n, GROUPS + 1) + 0.5
        self.group_share = total / total.sum()
        self.share = (n + 0.5) / (np.bincount(self.group, n, GROUPS + 1) + 0.5 * self.size)[self.group]
        #: A word of the rest has (its count + 0.5) of this many.
        self.rest = rest_n + 0.5 * (rest_kinds + 1)
        by_hash = np.argsort(hashes)
        self.keys, self.entry = hashes[by_hash], entry[by_hash]


@dataclass
class Counts:
    """What the scores need of the counts: n, distinct, the common words (sorted hashes, their counts), the model's words."""

    n: int
    distinct: int
    ends: int
    keys: np.ndarray
    counts: np.ndarray
    words: Vocabulary


def count_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, g, c) of all tokens of the rows, ends among them."""

    def worker():
        held: list[list[np.ndarray]] = []

        def merge() -> None:
            h, g, c = (np.concatenate(x) for x in zip(*held))
            h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            held[:] = [[h, g[first], np.bincount(inverse, c, len(h)).astype(np.int64)]]

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1].astype(np.int32)), pa.array(held[0][2])], ["h", "g", "c"])
            held.clear()
            return out

        def work(batch: pa.RecordBatch):
            t = Tokens(batch.column(1))
            c = np.bincount(t.flat[t.flat >= 0], minlength=len(t.hashes)).astype(np.int64)
            held.append([np.append(t.hashes, _signed(END_HASH)), np.append(t.groups, GROUPS), np.append(c, batch.num_rows)])
            if sum(len(x[0]) for x in held) > FLUSH:
                merge()
                if len(held[0][0]) > FLUSH // 2:
                    return batch_of()
            return None

        def finish():
            if held:
                merge()
                yield batch_of()

        work.finish = finish  # type: ignore[attr-defined]
        return work

    return map_texts(df, id_col, text_col, worker, "h bigint, g int, c bigint", limit=SLICE).groupBy("h", "g").agg(F.sum("c").alias("c"))


def summarise(counts: DataFrame, common: int, density: float) -> Counts:
    """The bounded part of the counts that every task gets: the ``common`` commonest words at most, and the words that
    occur n ** (2 / 3) / ``density`` times or more among n tokens, of which there are ``density`` * n ** (1 / 3) at most."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("n")).collect()  # some hundred rows at most
    n, distinct = sum(r["n"] for r in levels), sum(r["words"] for r in levels)
    taken, floor = 0, 1 << 30
    for r in sorted(levels, key=lambda r: -r["level"]):
        if taken + r["words"] > common:
            break
        taken, floor = taken + r["words"], r["level"]
    often = F.col("c") >= max(3.0, n ** (2 / 3) / density)
    rows = counts.where((level >= floor) | often | (F.col("g") == GROUPS)).select("h", "g", "c", often.alias("often")).toPandas()
    rows = rows.sort_values("h")
    words = rows[rows["often"] & (rows["g"] < GROUPS)]
    rest = counts.where(~often & (F.col("g") < GROUPS)).groupBy("g").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()  # a row for each group
    rest_n, rest_kinds = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in rest:
        rest_n[r["g"]], rest_kinds[r["g"]] = r["n"], r["kinds"]
    ends = int(rows.loc[rows["g"] == GROUPS, "c"].sum())
    vocabulary = Vocabulary(words["h"].to_numpy(np.int64), words["g"].to_numpy(np.int64), words["c"].to_numpy(float), rest_n, rest_kinds, ends)
    return Counts(n, distinct, ends, rows["h"].to_numpy(np.int64), rows["c"].to_numpy(np.int64), vocabulary)


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Log of the sum of every row's exponentials; ``s`` is overwritten."""
    top = 0.0
    if s.max() > 60 or s.min() < -60:  # else single precision holds them as they are
        top = s.max(1)
        s -= top[:, None]
    return np.log(np.exp(s, out=s) @ np.ones(s.shape[1], s.dtype)) + top


class LogBilinear:
    """Vectors of entries as context (r) and within their group (e), of groups (u), weights of the two places (c). The last
    number of e and u is a bias; predicted vectors end in a one."""

    def __init__(self, words: Vocabulary, size: int = 16, seed: int = 8):
        draw = np.random.default_rng(seed)
        self.words, self.size = words, size
        n = len(words.group)
        self.r = draw.normal(0, 0.1, (n, size)).astype(np.float32)
        self.e = draw.normal(0, 0.1, (n, size + 1)).astype(np.float32)
        self.e[:, size] = np.log(words.share)
        self.u = draw.normal(0, 0.1, (GROUPS + 1, size + 1)).astype(np.float32)
        self.u[:, size] = np.log(words.group_share)
        self.c = np.ones((2, size), np.float32)
        self.tokens = 0  # learned from

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        q = np.ones((len(one), self.size + 1), np.float32)
        q[:, :-1] = self.r[one] * self.c[0] + self.r[two] * self.c[1]
        return q

    def log_p(self, one: np.ndarray, two: np.ndarray, entry: np.ndarray, chunk: int = 8192) -> np.ndarray:
        """Natural log of the normalised probability of every entry after its two predecessors."""
        n, words = len(self.e), self.words
        context, inverse = np.unique(one * n + two, return_inverse=True)
        q = self.predicted(context // n, context % n)
        log_z = np.empty(len(q), np.float32)
        for i in range(0, len(q), chunk):
            log_z[i : i + chunk] = _log_sum(q[i : i + chunk] @ self.u.T)
        group = words.group[entry]
        out = np.empty(len(entry))
        for i in range(0, len(entry), 4 * chunk):
            at, g = inverse[i : i + 4 * chunk], group[i : i + 4 * chunk]
            out[i : i + 4 * chunk] = np.einsum("ij,ij->i", q[at], self.u[g]) - log_z[at]
        order = _order(group, GROUPS + 1)
        cuts = np.searchsorted(group[order], np.arange(GROUPS + 2))
        for g in np.flatnonzero((np.diff(cuts) > 0) & (words.size > 1)).tolist():
            first, last = words.start[g], words.start[g] + words.size[g]
            e = self.e[first:last].T
            rows = max(256, (chunk * GROUPS) // int(words.size[g]))
            for i in range(cuts[g], cuts[g + 1], rows):
                at = order[i : min(i + rows, cuts[g + 1])]
                s = q[inverse[at]] @ e
                out[at] += s[np.arange(len(at)), entry[at] - first]
                out[at] -= _log_sum(s)
        return out


class Trainer:
    """Noise-contrastive estimation with AdaGrad. The noise groups of a batch are shared by its tokens; noise entries are
    drawn for each token from its group."""

    def __init__(self, model: LogBilinear, batch: int = 4096, noise: int = 64, k: float = 16.0, within: int = 1, pool: int = 1024, rate: float = 0.1, seed: int = 0):
        self.m, self.batch, self.noise, self.k, self.within, self.pool, self.rate = model, batch, noise, k, within, pool, rate
        self.draw = np.random.default_rng((8, seed))
        words = model.words
        self.log_kg = np.log(k * words.group_share).astype(np.float32)
        self.log_ke = np.log(within * words.share).astype(np.float32)
        self.groups_up_to = np.cumsum(words.group_share)
        self.up_to = np.cumsum(words.share)  # every group adds one
        self.seen = {name: np.ones_like(getattr(model, name)) for name in "reuc"}
        self.times = np.zeros(len(words.group), np.int64)  # how often an entry was learned from
        self.tokens = 0

    def learn(self, one: np.ndarray, two: np.ndarray, entry: np.ndarray) -> None:
        words, groups = self.m.words, np.arange(GROUPS + 1)[:, None]
        # noise entries of every group, drawn anew for every slice
        x = np.searchsorted(self.up_to, groups + self.draw.random((GROUPS + 1, self.pool)))
        self.drawn = np.clip(x, words.start[groups], (words.start + words.size - 1)[groups])
        for i in range(0, len(entry), self.batch):
            self._step(one[i : i + self.batch], two[i : i + self.batch], entry[i : i + self.batch])
        self.tokens += len(entry)
        for x in (one, two, entry):
            self.times += np.bincount(x, minlength=len(self.times))

    def _step(self, one, two, entry) -> None:
        m, words = self.m, self.m.words
        q = m.predicted(one, two)
        group = words.group[entry]
        # the group among all groups
        x = np.minimum(np.searchsorted(self.groups_up_to, self.draw.random(self.noise)), GROUPS)
        own, other = m.u[group], m.u[x]
        g_true = _up(np.einsum("ij,ij->i", q, own) - self.log_kg[group])
        g_false = (self.k / self.noise) * (_up(q @ other.T - self.log_kg[x]) - 1)
        g_q = g_true[:, None] * own + g_false @ other
        self._add("u", np.concatenate((group, x)), np.concatenate((g_true[:, None] * q, g_false.T @ q)))
        # the entry among those of its group
        at = np.flatnonzero(words.size[group] > 1)
        if len(at):
            entry, group, p = entry[at], group[at], q[at]
            x = self.drawn[group[:, None], self.draw.integers(0, self.drawn.shape[1], (len(at), self.within), np.int32)]
            own, other = m.e[entry], m.e[x]
            g_true = _up(np.einsum("ij,ij->i", p, own) - self.log_ke[entry])
            g_false = _up(np.einsum("ij,ikj->ik", p, other) - self.log_ke[x]) - 1
            g_q[at] += g_true[:, None] * own + np.einsum("ik,ikj->ij", g_false, other)
            self._add("e", np.concatenate((entry, x.ravel())), np.concatenate((g_true[:, None] * p, (g_false[:, :, None] * p[:, None, :]).reshape(-1, p.shape[1]))))
        g_q = g_q[:, :-1]
        g_c = np.stack([(g_q * m.r[one]).sum(0), (g_q * m.r[two]).sum(0)])
        self._add("r", np.concatenate((one, two)), np.concatenate((g_q * m.c[0], g_q * m.c[1])))
        self._add("c", np.arange(2), g_c)

    def _add(self, name: str, at: np.ndarray, g: np.ndarray) -> None:
        """One AdaGrad step of the rows ``at``; gradients of equal rows are summed first."""
        part, seen = getattr(self.m, name), self.seen[name]
        order = _order(at, len(part))
        places = at[order]
        first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        places, g = places[first], np.add.reduceat(g[order], first, axis=0)
        seen[places] += g * g
        part[places] += self.rate * g / np.sqrt(seen[places])


def _order(numbers: np.ndarray, below: int) -> np.ndarray:
    """Stable sorting order; small numbers are sorted by digits."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


def _up(score: np.ndarray) -> np.ndarray:
    """One minus the logistic function."""
    return 1 / (1 + np.exp(np.clip(score, -30, 30)))


def _rows(model: LogBilinear, times: np.ndarray, tokens: int):
    """(i, n, x): the vectors of the entries that were learned from, of all groups, and of the places, with their weights."""
    n = len(model.e)
    touched = np.flatnonzero(times)
    entries = np.concatenate((model.r[touched], model.e[touched]), axis=1)
    for i, weight, x in ((touched, times[touched], entries), (n + np.arange(GROUPS + 1), np.full(GROUPS + 1, tokens), model.u), (np.array([n + GROUPS + 1]), np.array([tokens]), model.c.reshape(1, -1))):
        for lo in range(0, len(i), 4096):
            part = np.ascontiguousarray(x[lo : lo + 4096], np.float32)
            offsets = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(i[lo : lo + 4096]), pa.array(weight[lo : lo + 4096].astype(float)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))], ["i", "n", "x"])


def _take(model: LogBilinear, i: np.ndarray, x: np.ndarray) -> None:
    n, size = len(model.e), model.size
    own = i < n
    model.r[i[own]], model.e[i[own]] = x[own, :size], x[own, size : 2 * size + 1]
    own = (i >= n) & (i <= n + GROUPS)
    model.u[i[own] - n] = x[own, : size + 1]
    for row in x[i > n + GROUPS]:
        model.c[:] = row[: 2 * size].reshape(2, size)


def train(df: DataFrame, counts: Counts, id_col: str, text_col: str, rounds: int = 2, size: int = 16) -> LogBilinear:
    """Each round takes its share of the training documents and learns from every token of them."""
    model = LogBilinear(counts.words, size)
    spark = df.sparkSession
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        own = df.where(F.pmod(F.xxhash64(id_col), F.lit(rounds)) == turn)

        def worker(shared=shared, turn=turn):
            at = TaskContext.get()
            trainer = Trainer(_copy(shared.value), seed=turn + rounds * (at.partitionId() if at else 0))
            words = trainer.m.words

            def work(batch: pa.RecordBatch):
                t = Tokens(batch.column(1))
                entries = t.entries(words)
                one, two = t.contexts(entries, words.end)
                order = trainer.draw.permutation(len(entries))
                trainer.learn(one[order], two[order], entries[order])

            def finish():
                yield from _rows(trainer.m, trainer.times, trainer.tokens)

            work.finish = finish  # type: ignore[attr-defined]
            return work

        found = map_texts(own, id_col, text_col, worker, "i bigint, n double, x array<float>", limit=SLICE)
        # dealt by row before the sums, so that the tasks' vectors are shuffled as they are
        sums = [(F.sum(F.col("n") * F.get("x", F.lit(j))) / F.sum("n")).alias(f"x{j}") for j in range(2 * size + 1)]
        rows = found.repartition("i").groupBy("i").agg(F.sum("n").alias("n"), *sums).toPandas()  # a row for each entry and group
        x = rows[[f"x{j}" for j in range(2 * size + 1)]].to_numpy(float)
        i = rows["i"].to_numpy(np.int64)
        places = i == len(model.e) + GROUPS + 1
        if len(rows) and np.isfinite(x[places][:, : 2 * size]).all():
            _take(model, i, x)
            model.tokens += int(rows["n"].to_numpy()[places].sum())
        shared.unpersist()
    return model


def _copy(model: LogBilinear) -> LogBilinear:
    """A task's own: tasks of one worker share what was broadcast."""
    out = object.__new__(LogBilinear)
    out.__dict__.update(model.__dict__)
    for name in "reuc":
        setattr(out, name, getattr(model, name).copy())
    return out


def score_texts(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", density: float = 200.0, common: int = 100_000, rounds: int = 2) -> DataFrame:
    """Log10 probabilities of every whole text, an end among its tokens.

    Learns from the rows where ``held_out`` is false. Columns: id, held_out, n_tokens, n_known (tokens that training
    has), train_tokens, base_score (smoothed unigram), score (the neural model). A null or empty text is an end alone.
    Words that occur n ** (2 / 3) / ``density`` times or more in n training tokens, and three times at least, have
    vectors of their own. Counts of words beyond the ``common`` ones, which every task has, are joined. Repeated rows
    give a row each; other columns are not read. Without training rows all words are unknown.
    """
    kind = df.schema[id_col].dataType.simpleString()
    train_rows = df.where(~F.coalesce(held_out, F.lit(False)))
    counted = materialize(count_words(train_rows, id_col, text_col), "counts")
    counts = summarise(counted, common, density)
    model = train(train_rows, counts, id_col, text_col, rounds)
    shared = df.sparkSession.sparkContext.broadcast((counts, model))

    def worker():
        counts, model = shared.value
        vocabulary = model.words
        rest_log = np.append(np.log10(vocabulary.rest), 0.0)

        def work(batch: pa.RecordBatch):
            t = Tokens(batch.column(1))
            known = t.find(counts.keys, counts.counts, np.full(len(t.hashes), -1))
            c = np.append(known, 0)[t.flat]
            entries = t.entries(vocabulary)
            ends = t.flat < 0
            one, two = t.contexts(entries, vocabulary.end)
            group = vocabulary.group[entries]
            rare = (c < 0) & ~ends
            rest = ~ends & (entries == vocabulary.start[group])
            base = np.where(rare | ends, 0.0, np.log10(np.maximum(c, 0) + 0.5))
            neural = model.log_p(one, two, entries) / np.log(10) + np.where(rest, base - rest_log[group], 0.0)
            n = len(t.sizes)
            key, times = np.unique(t.doc[rare] * max(1, len(t.hashes)) + t.flat[rare], return_counts=True)
            of, which = key // max(1, len(t.hashes)), key % max(1, len(t.hashes))
            cuts = np.searchsorted(of, np.arange(n + 1))
            offsets = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (t.hashes[which], times.astype(np.int32))]
            per = lambda x: np.bincount(t.doc, x, n)
            columns = [ids(batch), batch.column(2), pa.array(t.sizes), pa.array(per(~rare & ~ends & (c > 0)).astype(np.int64)), pa.array(per(base)), pa.array(per(neural)), *lists]
            return pa.RecordBatch.from_arrays(columns, names)

        return work

    names = ["id", "held_out", "n_tokens", "known", "base", "neural", "rare", "times"]
    schema = f"id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, neural double, rare array<bigint>, times array<int>"
    rows = materialize(map_texts(df, id_col, text_col, worker, schema, {"held_out": F.coalesce(held_out, F.lit(False))}, limit=SLICE), "scores")
    # rare words: by document and word, joined with the counts; all of them are of the rest of their group
    version = F.xxhash64("n_tokens", "known", "base", "neural", F.size("rare"), "rare")
    rows = rows.withColumn("version", version)
    rare = rows.where(F.size("rare") > 0).select("id", "version", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("id", "version", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    found = rare.join(counted, "h", "left").groupBy("id", "version").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"))
    found = found.select(F.col("id").alias("i"), F.col("version").alias("v"), "rest", "more")
    copies = rows.groupBy("id", "held_out", "n_tokens", "known", "base", "neural", "version").agg(F.count(F.lit(1)).alias("copies"))
    both = copies.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")), "left")
    rest = F.coalesce(F.col("rest") / F.col("copies"), F.lit(0.0))
    more = F.coalesce((F.col("more") / F.col("copies")).cast("long"), F.lit(0))
    base = F.col("base") + rest + F.lit(float(np.log10(counts.ends + 0.5))) - F.col("n_tokens") * F.lit(float(np.log10(counts.n + 0.5 * (counts.distinct + 1))))
    known = F.col("known") + more + (1 if counts.ends else 0)
    both = both.select(F.col("id").alias(id_col), "held_out", "n_tokens", known.alias("n_known"), F.lit(int(counts.n)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("neural") + rest).alias("score"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return both.drop("_copy")
