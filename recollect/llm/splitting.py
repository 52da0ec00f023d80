"""Cutting oversized texts into pieces at natural boundaries, by recursive bisection.

A text over the limit is cut at the strongest boundary near its middle (paragraph, line, sentence, clause, word;
otherwise between any two characters) and both halves are treated alike, until each is within the limit less the overlap.
Then every piece but the first gets the last tokens of the one before in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 4
_BOUNDARIES = [re.compile(p) for p in (r"\n[ \t]*\n\s*", r"\n+\s*", r"(?<=[.!?…])[\"'”’)\]]*\s+", r"(?<=[,;:])\s+", r"\s+")]


def _cuts(text: str, size: np.ndarray) -> list[np.ndarray]:
    """Of each strength, the byte offsets at which a piece may begin, ascending."""
    return [np.unique(size[[m.end() for m in p.finditer(text)]]) for p in _BOUNDARIES]


def split_text(text: str | None, limit: int = 500, overlap: int = 50) -> list[tuple[int, int, int]]:
    """The pieces of a text as (first character, first character that isn't repeated, end), each of at most ``limit``
    tokens (octets of UTF-8 div 4), repeating about ``overlap`` tokens of the one before, from the beginning of a word
    where there is one. None, the empty text and texts within the limit are not cut: one piece, or none for None and ''.
    """
    if not text:
        return []
    if overlap >= limit:
        raise ValueError("the overlap must be smaller than the limit")
    width = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.concatenate([[0], np.cumsum(1 + (width > 0x7F) + (width > 0x7FF) + (width > 0xFFFF))])
    most = limit * BYTES_PER_TOKEN + BYTES_PER_TOKEN - 1
    if size[-1] <= most:
        return [(0, 0, len(text))]
    core = most - overlap * BYTES_PER_TOKEN
    cuts = _cuts(text, size)
    pieces, todo = [], [(0, int(size[-1]))]
    while todo:
        a, b = todo.pop()
        if b - a <= core:
            pieces.append((a, b))
            continue
        cut = None
        # near the middle: within a quarter of the stretch, a stronger boundary before a nearer one
        for at in cuts:
            lo, hi = np.searchsorted(at, [a + (b - a) // 4, b - (b - a) // 4])
            if lo < hi:
                cut = int(at[lo:hi][np.abs(at[lo:hi] - (a + b) // 2).argmin()])
                break
        if cut is None or not a < cut < b:
            cut = int(size[np.searchsorted(size, (a + b) // 2)])
            if not a < cut < b:
                cut = int(size[np.searchsorted(size, a, "right")])
        if not a < cut < b:  # a single character
            pieces.append((a, b))
            continue
        todo += [(cut, b), (a, cut)]
    out = []
    for a, b in pieces:
        i, j = np.searchsorted(size, [a, b])
        k = i
        if a:
            k = int(np.searchsorted(size, a - overlap * BYTES_PER_TOKEN))
            word = re.compile(r"(?<=\s)\S").search(text, k, i) if k and not text[k - 1].isspace() else None
            k = max(out[-1][1], word.start() if word else k)
        out.append((int(k), int(i), int(j)))
    return out


def pieces(df: DataFrame, id_col: str, text_col: str, limit: int = 500, overlap: int = 50) -> DataFrame:
    """The pieces of all texts of more than ``limit`` tokens: (id, piece, start_pos, new_pos, end_pos, n_tokens, content).

    Sizes are taken from the texts, never from a stored count. Records with the same id and text are cut once; texts
    within the limit, null and empty ones give no row; other columns are ignored. Without the overlaps, from ``new_pos`` to
    ``end_pos``, the pieces of a text add up to it.
    """
    schema = pa.schema([("id", pa.string()), ("piece", pa.int32()), ("start_pos", pa.int64()), ("new_pos", pa.int64()), ("end_pos", pa.int64()), ("n_tokens", pa.int64()), ("content", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, (s, new, e) in enumerate(split_text(t, limit, overlap)):
                    rows.append((i, n, s, new, e, len(t[s:e].encode("utf-8", "surrogatepass")) // BYTES_PER_TOKEN, t[s:e]))
            cols = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    large = src.where(F.floor(F.octet_length("t") / BYTES_PER_TOKEN) > limit).distinct()
    return large.mapInArrow(run, "id string, piece int, start_pos bigint, new_pos bigint, end_pos bigint, n_tokens bigint, content string")
