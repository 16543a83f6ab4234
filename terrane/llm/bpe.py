"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task's texts are its corpus, read in slices. The distinct pre-tokens that a slice brings in are laid out in
one symbol array; an inverted index leads from the rank of a merge, which all token pairs that make the same
token share, to the positions where such pairs stand, and the merges are applied in rank order, touching only
the neighbours of what was merged. The task keeps the ids of its pre-tokens, so each of them is merged once.
Texts are put together from their pre-tokens' ids. What a task keeps is bounded; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terrane.llm.common import ids, map_texts, texts

SHIFT = 20
#: A task keeps the ids of so many pre-tokens, of so many bytes, before it starts anew.
KEPT_WORDS, KEPT_BYTES = 1 << 18, 8 << 20
#: Bytes of a slice; the replay of its new pre-tokens takes some fifty for each of theirs.
SLICE = 2 << 20


class Merges:
    """The ranks of a vocabulary file with what replay and decoding look up."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        get = ranks.get
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left = get(piece[:cut])
                if left is not None and (right := get(piece[cut:])) is not None:
                    pairs[left << SHIFT | right] = rank
        self.pair_rank = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it does not merge."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)


@lru_cache(4)
def load_merges(path: str) -> Merges:
    with open(path, "rb") as f:
        return Merges({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def encode_one(merges: Merges, word: bytes) -> list[int]:
    """One word by a heap of (rank, position): the lowest rank first, from the left."""
    symbols = [int(merges.single[b]) for b in word]
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = merges.pair_rank.get
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank(symbols[i] << SHIFT | symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = r, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := rank(r << SHIFT | symbols[k])) is not None:
                heapq.heappush(heap, (q, i, r, symbols[k]))
        if (h := before[i]) >= 0 and (q := rank(symbols[h] << SHIFT | r)) is not None:
            heapq.heappush(heap, (q, h, symbols[h], r))
    return [s for s in symbols if s >= 0]


def replay(merges: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and the number of ids of each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64), sizes
    symbols = merges.single[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    after = np.arange(1, total + 1)
    after[np.cumsum(sizes[sizes > 0]) - 1] = -1
    before = np.full(total, -1, np.int64)
    linked = np.flatnonzero(after >= 0)
    before[after[linked]] = linked
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []
    odd: list[np.ndarray] = []

    def enter(at: np.ndarray, floor: int) -> None:
        """Put the pairs that begin at these positions into the index."""
        rank = merges.rank_of(symbols[at], symbols[after[at]])
        fits = rank >= 0
        at, rank = at[fits], rank[fits]
        if not len(at):
            return
        low = rank <= floor
        if low.any():  # such a word does not follow the rank order: it is encoded alone
            odd.append(word[at[low]])
            at, rank = at[~low], rank[~low]
            if not len(at):
                return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        first = [0, *cuts.tolist()]
        for lo, hi, r in zip(first, [*first[1:], len(at)], rank[first].tolist()):
            if r in index:
                index[r].append(at[lo:hi])
            else:
                index[r] = [at[lo:hi]]
                heapq.heappush(heap, r)

    enter(linked, -1)
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[(symbols[at] >= 0) & (after[at] >= 0)]
        if not len(at):
            continue
        right = after[at]
        still = merges.rank_of(symbols[at], symbols[right]) == r
        at, right = at[still], right[still]
        if not len(at):
            continue
        if len(at) > 1:
            at.sort()
            right = after[at]
            follows = right[:-1] == at[1:]
            if follows.any():  # overlapping pairs: the left one first
                keep = np.ones(len(at), bool)
                for i in (np.flatnonzero(follows) + 1).tolist():
                    keep[i] = not keep[i - 1]
                at, right = at[keep], right[keep]
        symbols[at] = r
        symbols[right] = -1
        beyond = after[right]
        after[at] = beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        left = before[at]
        enter(np.unique(np.concatenate((at[has], left[left >= 0]))), r)
    alive = symbols >= 0
    out, counts = symbols[alive], np.bincount(word[alive], minlength=len(words))
    if odd:
        ends = np.cumsum(counts)
        again = np.unique(np.concatenate(odd)).tolist()
        pieces, last = [], 0
        for w in again:
            own = np.array(encode_one(merges, words[w]), np.int64)
            pieces += [out[last : ends[w] - counts[w]], own]
            last, counts[w] = ends[w], len(own)
        out = np.concatenate([*pieces, out[last:]])
    return out, counts


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every run, end to end."""
    total = int(lengths.sum())
    skip = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(skip, lengths) + np.arange(total)


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Corpus:
    """The distinct pre-tokens of a task with their ids."""

    def __init__(self, merges: Merges, pattern):
        self.merges, self.find = merges, pattern.findall
        self._clear()

    def _clear(self) -> None:
        self.number = _Numbered()
        self.tokens, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.starts, self.size = np.zeros(0, np.int64), 0

    def encode(self, docs: list[str]) -> list[np.ndarray]:
        """Ids of every text of a slice."""
        known = len(self.number)
        look = self.number.__getitem__
        own = [np.fromiter(map(look, found := self.find(d)), np.int64, len(found)) if d else np.zeros(0, np.int64) for d in docs]
        if len(self.number) > known:
            new = [w.encode() for w in islice(self.number, known, None)]
            tokens, counts = replay(self.merges, new)
            self.tokens, self.counts = np.concatenate((self.tokens, tokens.astype(np.int32))), np.concatenate((self.counts, counts))
            self.starts = np.cumsum(self.counts) - self.counts
            self.size += sum(map(len, new))
        out = [self.tokens[spread(self.starts[w], self.counts[w])].astype(np.int64) if len(w) else w for w in own]
        if len(self.number) > KEPT_WORDS or self.size > KEPT_BYTES:
            self._clear()
        return out


def encode_slice(merges: Merges, pattern, docs: list[str]) -> list[np.ndarray]:
    """Ids of every text of a slice alone."""
    return Corpus(merges, pattern).encode(docs)


def decode(merges: Merges, tokens: np.ndarray) -> bytes:
    """The bytes of the ids."""
    return merges.bytes[spread(merges.starts[tokens], merges.lengths[tokens])].tobytes() if len(tokens) else b""


def byte_bpe(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text.

    Columns: id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array<int>) and decoded (binary).
    A null text counts as empty: no tokens, the digests of no bytes. Repeated rows give a row each; other columns
    are not read. ``ranks_path`` must exist on every executor.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def worker():
        merges = load_merges(ranks_path)
        corpus = Corpus(merges, regex.compile(pattern))

        def work(batch: pa.RecordBatch):
            found = corpus.encode(texts(batch))
            decoded = [decode(merges, t) for t in found]
            columns = [ids(batch), pa.array([len(t) for t in found], pa.int64()), pa.array([hashlib.sha256(t.astype("<u4").tobytes()).hexdigest() for t in found], pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array([t.astype(np.int32) for t in found], pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(columns, names)

        return work

    more = ", ids array<int>, decoded binary" if keep_ids else ""
    return map_texts(df, id_col, text_col, worker, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}", limit=SLICE)


__all__ = ["Corpus", "Merges", "byte_bpe", "decode", "encode_one", "encode_slice", "load_merges", "replay"]
