"""Vectorised reading of texts: one array of normalised characters for a whole Arrow batch."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np

SPACE = 32
_MARKS = re.compile(r"<[^<>\n]{1,80}>|^[ \t]*(?:\[[\d:.\- T]+\][ \t]*)?(?:[-*>#•|]+[ \t]+|\d+[.)][ \t]+)*(?:[^\W\d_]{2,14}:[ \t])?", re.M)


@lru_cache(1)
def _table() -> np.ndarray:
    """By code point: the small, unaccented letter or digit it stands for; SPACE for what separates words; 0 for what is
    invisible (format characters and combining marks)."""
    t = np.full(0x20000, SPACE, np.uint32)
    for c in range(0x20000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind in ("Cf", "Mn", "Me"):
            t[c] = 0
        elif kind[0] in "LN":
            plain = [x for x in unicodedata.normalize("NFKD", ch.lower()) if unicodedata.category(x)[0] in "LN"]
            t[c] = ord(plain[0].lower()) if plain and len(plain[0].lower()) == 1 else c
    return t


def strip_layout(text: str) -> str:
    """Without tags and, at the beginnings of lines, without time stamps, list and quotation marks and speakers."""
    return _MARKS.sub(" ", text)


def fold_batch(texts: list[str | None], strip: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, normalised, in one array, and where each text begins (one entry more than texts).
    Every word is followed by exactly one SPACE, which also ends each text."""
    parts = [strip_layout(t) if strip else t for t in (t or "" for t in texts)]
    joined = "\n".join(parts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    c = _table()[np.where(raw < 0x20000, raw, SPACE)]
    keep = c != 0
    prev = np.empty(len(c), np.uint32)
    seen = np.flatnonzero(keep)
    keep[:] = False
    v = c[seen]
    prev = np.concatenate([[SPACE], v[:-1]])
    keep[seen[(v != SPACE) | (prev != SPACE)]] = True
    pos = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], pos[np.concatenate([[0], ends])] if parts else pos[:1]


def words_of(chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a folded batch: where each word begins, a 64-bit hash of each, and the first word of each text (one entry
    more than texts)."""
    space = chars == SPACE
    begin = np.flatnonzero(np.concatenate([[True], space[:-1]]) & ~space)
    if not len(begin):
        return begin, np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    with np.errstate(over="ignore"):
        at = np.arange(len(chars), dtype=np.int64) - np.repeat(begin, np.diff(np.append(begin, len(chars))))[: len(chars)] if begin[0] == 0 else None
        if at is None:
            owner = np.searchsorted(begin, np.arange(len(chars)), "right") - 1
            at = np.arange(len(chars)) - begin[np.maximum(owner, 0)]
        mixed = (chars.astype(np.uint64) + np.uint64(0x9E37)) * _POWERS[np.minimum(at, 255)]
        mixed[space] = 0
        h = np.add.reduceat(mixed, begin)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    assert len(ends) == len(begin)
    return begin, h, np.searchsorted(begin, starts)


with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(256, 0x100000001B3 * 3 + 2, np.uint64)) | np.uint64(1)
