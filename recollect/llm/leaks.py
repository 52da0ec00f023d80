"""Evaluation texts that leaked into documents, by q-gram filtering and banded alignment.

The items' character q-grams are an index on every executor. A document's q-grams that occur in it are hits on a
diagonal (position in the document less position in the item); edits move a match by few diagonals, so hits are counted in
overlapping diagonal bands. By the q-gram lemma a stretch of n characters with k edits keeps at least n + 1 - q (k + 1)
of its q-grams; a band that has fewer hits within the stretch's length cannot hold a match. What remains is verified
by alignment of words in the diagonals around the region's hits, many regions at a time.

Why four edits decide: of a match with one word in ten edited and five edits or more, two neighbouring exact stretches and the
edit between them have 15 words. So windows of 15, 19, 29 and 39 words with 1, 2, 3 and 4 edits hold every match or a part
of it that is one, and an alignment with EDITS edits finds it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.text import fold_batch, words_of

QS = (16, 8)  # multiples of 4; the lemma leaves hits of 15 words of any length with the last
BAND = 128  # a match whose edits displace it by up to BAND / 2 characters lies in one band
MIN_WORDS = 15
MIN_HITS = 8
EDITS = 6
MARGIN = 32  # words around a region that are aligned with it
MAX_INDEX_CHARS = 64_000_000
_BITS = 22
_NEVER = -(1 << 20)


def budget(words: int) -> int:
    """The edits allowed in a stretch: about one word in ten, one in any case."""
    return max(1, (words + 1) // 10)


@dataclass
class Index:
    """Of the items that are searched with one length of q-grams."""

    q: int
    ids: np.ndarray
    words: np.ndarray  # the hashes of all items' words
    first: np.ndarray  # the first word of each item, and the number of all
    grams: np.ndarray  # sorted
    item: np.ndarray
    pos: np.ndarray
    word: np.ndarray  # the word of its item in which each q-gram begins
    bits: np.ndarray
    least: np.ndarray  # of each item, the least hits of a match
    fewest: int
    window: int


def _grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A hash of the ``q`` characters from each position on."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        c = chars.astype(np.uint64)
        step = np.uint64(0x9E3779B97F4A7C15)
        two = c[:-1] * step + c[1:]
        four = two[:-2] * step * step + two[2:]
        h = np.zeros(n, np.uint64)
        for k in range(0, q, 4):
            h = h * step * step * step * step + four[k : k + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _least_hits(begin: np.ndarray, min_words: int, q: int) -> tuple[int, int]:
    """By the lemma, the least q-grams that a match of an item keeps, and the most characters of the stretches regarded; ``begin``:
    where its words begin and the last ends. Altering or losing a word of w characters with the blank after it costs up to
    w + q of them."""
    least, window = 1 << 30, 0
    size = np.diff(begin)
    for n in {min_words, *(k for k in (19, 29, 39) if k > min_words)}:
        if len(size) >= n:
            s = np.sort(np.lib.stride_tricks.sliding_window_view(size, n), axis=1)
            least = min(least, int((s.sum(1) + 1 - q - (s[:, -budget(n) :] + q).sum(1)).min()))
            window = max(window, int(s.sum(1).max()))
    return least, window


def build_index(items: list[tuple[int, str]], min_words: int = MIN_WORDS) -> list[Index]:
    """Each item under the longest q-grams of which a match keeps MIN_HITS; items of fewer than ``min_words`` words are left out."""
    chars, starts = fold_batch([t for _, t in items])
    begin, h, first = words_of(chars, starts)
    ends = [np.append(begin[a:b], s) for a, b, s in zip(first, first[1:], starts[1:])]
    out, todo = [], [i for i in range(len(items)) if first[i + 1] - first[i] >= min_words]
    for q in QS:
        bounds = {i: _least_hits(ends[i], min_words, q) for i in todo}
        own = [i for i in todo if bounds[i][0] >= MIN_HITS or q == QS[-1]]
        todo = [i for i in todo if bounds[i][0] < MIN_HITS and q != QS[-1]]
        if not own:
            continue
        g = _grams(chars, q)
        at = np.concatenate([np.arange(starts[i], max(starts[i], starts[i + 1] - q + 1)) for i in own])
        owner = np.repeat(np.arange(len(own)), [max(0, starts[i + 1] - q + 1 - starts[i]) for i in own])
        order = np.argsort(g[at], kind="stable")
        at, owner = at[order], owner[order]
        number = np.array(own)
        bits = np.zeros(1 << _BITS, bool)
        bits[g[at] >> np.uint64(64 - _BITS)] = True
        least = np.array([max(1, bounds[i][0]) for i in own])
        word = np.searchsorted(begin, at, "right") - 1 - first[number[owner]]
        out.append(Index(
            q, np.array([items[i][0] for i in own], np.int64), np.concatenate([h[first[i] : first[i + 1]] for i in own]),
            np.concatenate([[0], np.cumsum(first[number + 1] - first[number])]), g[at], owner.astype(np.int32), (at - starts[number[owner]]).astype(np.int32),
            word.astype(np.int32), bits, least, int(least.min()), max(bounds[i][1] for i in own) + BAND,
        ))
    return out


def _dense(index: Index, at: np.ndarray) -> np.ndarray:
    """Which of the ascending positions lie in some window of the index's size with at least its number of them."""
    k = index.fewest - 1
    if len(at) <= k:
        return np.zeros(len(at), bool)
    full = np.flatnonzero(at[k:] - at[: len(at) - k] <= index.window)
    mark = np.zeros(len(at) + 1, np.int32)
    np.add.at(mark, full, 1)
    np.add.at(mark, full + k + 1, -1)
    return np.cumsum(mark[:-1]) > 0


def _regions(index: Index, chars: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The stretches with enough hits in a diagonal band, one row each: text, item, first and last word of the item that the hits lie
    in, least and largest difference between the words' numbers in the batch and in the item."""
    g = _grams(chars, index.q)
    none = np.zeros((0, 6), np.int64)
    at = np.flatnonzero(index.bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
    at = at[_dense(index, at)]
    lo = np.searchsorted(index.grams, g[at], "left")
    known = index.grams[np.minimum(lo, len(index.grams) - 1)] == g[at] if len(index.grams) else np.zeros(len(at), bool)
    at, lo = at[known], lo[known]
    near = _dense(index, at)
    at, lo = at[near], lo[near]
    if not len(at):
        return none
    n = np.searchsorted(index.grams, g[at], "right") - lo
    hit = np.repeat(at, n)
    entry = np.repeat(lo, n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
    item, diag = index.item[entry].astype(np.int64), hit - index.pos[entry]
    text = np.searchsorted(starts, hit, "right") - 1
    base = int(index.pos.max()) + BAND
    out = []
    k = index.fewest - 1
    for shift in (0, BAND // 2):
        # one number for text, item and band; hits stay ascending within it
        code = (text * len(index.ids) + item) * ((len(chars) + 2 * base) // BAND + 2) + (diag + base + shift) // BAND
        order = np.argsort(code, kind="stable")
        c, h = code[order], hit[order]
        if len(c) <= k:
            continue
        full = np.flatnonzero((c[k:] == c[: len(c) - k]) & (h[k:] - h[: len(h) - k] <= index.window))
        if not len(full):
            continue
        new = np.flatnonzero(np.concatenate([[True], (c[full[1:]] != c[full[:-1]]) | (h[full[1:]] > h[full[:-1] + k] + index.window)]))
        first, last = full[new], np.append(full[new[1:] - 1], full[-1]) + k
        enough = last + 1 - first >= index.least[item[order[first]]]
        first, last = first[enough], last[enough]
        if not len(first):
            continue
        # of the hits of each region, the words of the item and the diagonals of words
        size = last + 1 - first
        inside = order[np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        cut = np.cumsum(size) - size
        word = index.word[entry[inside]].astype(np.int64)
        line = np.searchsorted(begin, hit[inside], "right") - 1 - word
        r = order[first]
        low, high = np.minimum.reduceat, np.maximum.reduceat
        out.append(np.column_stack([text[r], item[r], low(word, cut), high(word, cut), low(line, cut), high(line, cut)]))
    return np.unique(np.concatenate(out), axis=0) if out else none


def align(doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, size: np.ndarray, line: np.ndarray, width: int) -> np.ndarray:
    """Of each region, the most consecutive words of its item that its document repeats with no more edits than ``budget`` allows
    and EDITS at most; an edit is a word altered, lost or added, and both ends of a stretch are repeated words.

    ``doc``, ``item``: hashes of words; ``lo``, ``hi``: the document's words; ``start``, ``size``: the item's words to align;
    ``line``: the lowest of the ``width`` diagonals (word of ``doc`` less word of ``item``). The state of a row (a word of the
    item) is, by region, diagonal and number of edits, the length of the longest stretch that ends there.
    """
    regions, best = len(lo), np.zeros(len(lo), np.int32)
    if not regions:
        return best
    state = np.full((EDITS + 1, regions, width), _NEVER, np.int32)
    allowed = np.array([next(n for n in range(1, 10 * EDITS + 20) if budget(n) >= e) for e in range(EDITS + 1)])
    d = line[:, None] + np.arange(width)
    for i in range(int(size.max())):
        j = start[:, None] + i + d
        inside = (j >= lo[:, None]) & (j < hi[:, None]) & (i < size)[:, None]
        same = inside & (doc[np.clip(j, 0, len(doc) - 1)] == item[np.minimum(start + i, len(item) - 1)][:, None])
        old, state = state, np.empty_like(state)
        for e in range(EDITS + 1):
            # a repeated word goes on or begins; an altered, lost or added one costs an edit
            state[e] = np.where(same, np.maximum(old[e], 0 if e == 0 else _NEVER) + 1, _NEVER)
            np.maximum(best, np.where(state[e] >= allowed[e], state[e], 0).max(1), out=best)
            if e:
                np.maximum(state[e], old[e - 1] + 1, out=state[e])
                np.maximum(state[e][:, :-1], old[e - 1][:, 1:] + 1, out=state[e][:, :-1])
                np.maximum(state[e][:, 1:], state[e - 1][:, :-1], out=state[e][:, 1:])
                state[e][~inside] = _NEVER
    return best


def leaked_items(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, min_words: int = MIN_WORDS, max_chars: int = MAX_INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, words) for each document that repeats at least ``min_words`` consecutive words of an item, with
    the longest such run found, counted in the item's words. Case, accents, punctuation, tags, layout and invisible characters
    don't matter; about one word in ten may be altered, lost or added (``budget``), as far as that displaces the text by
    no more than BAND / 2 characters.

    - ``items``: the held-out set. It is sent to every executor, so its size is taken first; one of more than ``max_chars``
      characters is searched in several passes over the documents, each with a part of the items. Items with
      equal texts are searched once; items shorter than ``min_words`` words and null ids or texts cannot be found.
    - Null and empty texts repeat nothing; a document id on several rows gives each pair once, with its longest run. Other
      columns are ignored.
    """
    shape = "doc_id bigint, item_id bigint, words int"
    known = items.select(items[item_col].cast("long").alias("item_id"), items[item_text].alias("text")).where("item_id is not null and text <> ''")
    classes = known.groupBy("text").agg(F.min("item_id").alias("lead"))
    chars = classes.agg(F.sum(F.length("text"))).first()[0]
    if not chars:
        return docs.sparkSession.createDataFrame([], shape)
    passes = -(-chars // max_chars)
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("text <> ''")
    found = None
    for n in range(passes):
        part = classes.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == n)
        rows = [(r["lead"], r["text"]) for r in part.collect()]
        if rows:
            hits = src.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(rows), min_words), shape)
            found = hits if found is None else found.unionByName(hits)
    pairs = found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
    members = known.join(classes, "text").select(F.col("lead").alias("item_id"), F.col("item_id").alias("member")).distinct()
    if not members.where("member <> item_id").head(1):
        return pairs
    return pairs.join(members, "item_id").groupBy("doc_id", F.col("member").alias("item_id")).agg(F.max("words").alias("words"))


def _finder(source, min_words: int):
    kept: dict[str, list[Index]] = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = kept.get("index") or kept.setdefault("index", build_index(source.value, min_words))
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for a in _slices(texts):
                text, item, words = _search(indexes, texts[a], min_words)
                yield pa.RecordBatch.from_arrays([ids.slice(a.start, a.stop - a.start).take(pa.array(text)), pa.array(item), pa.array(words)], names=["doc_id", "item_id", "words"])

    return run


def _slices(texts: list[str], chars: int = 2_000_000) -> Iterator[slice]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _search(indexes: list[Index], texts: list[str], min_words: int, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item id, words) of the matches in a batch of texts."""
    chars, starts = fold_batch(texts)
    begin, h, first = words_of(chars, starts)
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for index in indexes:
        text, item, a, b, low, high = _regions(index, chars, starts, begin).T
        own = index.first[item + 1] - index.first[item]
        a, b = np.maximum(a - MARGIN, 0), np.minimum(b + MARGIN, own - 1)
        start, size, width = index.first[item] + a, b - a + 1, high - low + 1 + 2 * EDITS
        line = low - EDITS - index.first[item]
        # regions of like size together, so that rows and diagonals are not wasted
        order = np.lexsort((width, size))
        at = 0
        while at < len(order):
            n = max(1, min(len(order) - at, cells // int(width[order[at:]].max())))
            r = order[at : at + n]
            words = align(h, index.words, first[text[r]], first[text[r] + 1], start[r], size[r], line[r], int(width[r].max()))
            m = words >= min_words
            out.append((text[r][m], index.ids[item[r][m]], words[m]))
            at += n
    return tuple(np.concatenate(x) for x in zip(*out))
