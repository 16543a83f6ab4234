"""Token counts per section by offset-mapped attribution.

Every document is encoded once, as a whole. The tokens' byte spans are interval-joined with the spans of
the document's sections; a token that crosses a border counts for one section by a fixed rule.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.common import ids, map_texts, texts

RULES = ("majority", "first", "last")


@lru_cache(4)
def load_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def section_ends(data: bytes, separator: bytes) -> np.ndarray:
    """Byte end of every section; a separator belongs to the section that it closes."""
    ends, at = [], 0
    while (found := data.find(separator, at)) >= 0:
        at = found + len(separator)
        ends.append(at)
    if at < len(data) or not ends:
        ends.append(len(data))
    return np.array(ends, np.int64)


def attribute(ends: np.ndarray, sections: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Section of every token and whether it crosses a border.

    ``ends``: byte end of every token, in order; ``sections``: byte end of every section. majority: the section
    with most of the token's bytes, the earlier one of equals; first and last: that of its first or last byte.
    """
    starts = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(sections, starts, side="right")
    last = np.searchsorted(sections, ends - 1, side="right")
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    owner = first.copy()
    for i in np.flatnonzero(crossing).tolist():
        inner = np.arange(first[i], last[i] + 1)
        begin = np.maximum(starts[i], np.concatenate(([0], sections))[inner])
        owner[i] = inner[np.argmax(np.minimum(ends[i], sections[inner]) - begin)]
    return owner, crossing


def count_tokens(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", rule: str = "majority") -> DataFrame:
    """Tokens of every document and of each of its sections.

    Sections end behind each ``separator``; the rest, if any, is the last one. Columns: id, n_tokens, n_sections,
    n_crossing (tokens over a border), section_tokens array<int> (adds up to n_tokens), sections_sha256 (of those
    counts, comma-joined). A null or empty text is one empty section. Repeated rows give a row each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = df.schema[id_col].dataType.simpleString()
    mark = separator.encode()

    def worker():
        encoding, lengths = load_encoding(ranks_path, pattern)

        def work(batch: pa.RecordBatch):
            rows = []
            for text in texts(batch):
                tokens = np.array(encoding.encode_ordinary(text), np.int64)
                sections = section_ends(text.encode(), mark)
                owner, crossing = attribute(np.cumsum(lengths[tokens]), sections, rule) if len(tokens) else (tokens, tokens)
                counts = np.bincount(owner, minlength=len(sections))
                rows.append((len(tokens), len(sections), int(crossing.sum()), counts.astype(np.int32), hashlib.sha256(",".join(map(str, counts.tolist())).encode()).hexdigest()))
            n, s, x, c, h = zip(*rows)
            return pa.RecordBatch.from_arrays([ids(batch), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(x, pa.int64()), pa.array(c, pa.list_(pa.int32())), pa.array(h, pa.string())], [id_col, "n_tokens", "n_sections", "n_crossing", "section_tokens", "sections_sha256"])

        return work

    return map_texts(df, id_col, text_col, worker, f"`{id_col}` {kind}, n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<int>, sections_sha256 string")
