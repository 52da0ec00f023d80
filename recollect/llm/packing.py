"""Filling contexts of fixed capacity with texts: hierarchical multi-length packing.

Sizes are whole numbers up to the capacity, so their histogram is small whatever the corpus: at most ``capacity``
counts. The driver packs the histogram, not the texts. Items are routed to tiers (windows of the capacity, half of
it, a quarter, ...); the items of a tier first fill gaps of longer windows (the tightest that fits), the rest
open windows of their own tier; last, shorter windows are put together to contexts. The result is a list of patterns, each
so many contexts with the same sizes; an item finds its place by its rank among the items of its size. Ranks are
counted in two steps, within parts of PART_ROWS items or so and over the parts' totals, so that no task holds all items of a size.
The sizes are checkpointed, as they are needed for the histogram and for the ranks, and texts are read once.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import shared_checkpoint

PART_ROWS = 1_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's pre-tokens are cut.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, filter(str.strip, f))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of each row; a null or empty text has 0 tokens. Equal texts of a batch are counted once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            seen: dict[str, int] = {}
            n = [seen[t] if t in seen else seen.setdefault(t, len(enc.encode_ordinary(t))) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens bigint")


def pack_histogram(counts: dict[int, int], capacity: int, tiers: int = 4) -> list[tuple[tuple[int, ...], int, int]]:
    """Patterns (sizes in order, number of contexts, tier) that hold ``counts[size]`` items of each size."""
    widths = [capacity >> t for t in range(tiers)]
    # open windows of each tier: room left -> {contents: number}
    open_: list[dict[int, dict[tuple, int]]] = [defaultdict(lambda: defaultdict(int)) for _ in widths]
    rooms: list[list[int]] = [[] for _ in widths]

    def put(t: int, contents: tuple, room: int, n: int) -> None:
        if room not in open_[t] or not open_[t][room]:
            i = bisect.bisect_left(rooms[t], room)
            if i == len(rooms[t]) or rooms[t][i] != room:
                rooms[t].insert(i, room)
        open_[t][room][contents] += n

    def take(t: int, size: int, n: int) -> int:
        """Puts up to n items of a size into windows of tier t with the least room that fits; returns what is left."""
        while n:
            i = bisect.bisect_left(rooms[t], size)
            if i == len(rooms[t]):
                return n
            room = rooms[t][i]
            contents, have = open_[t][room].popitem()
            fit = room // size  # of one window
            full, rest = divmod(n, fit)
            use = min(have, full) or 1
            each = fit if full else rest
            if have > use:
                open_[t][room][contents] += have - use
            if not open_[t][room]:
                rooms[t].pop(i)
            put(t, contents + (size,) * each, room - size * each, use)
            n -= use * each
        return 0

    def tier(size: int) -> int:
        return max(t for t, w in enumerate(widths) if size <= w)

    for size in sorted((s for s in counts if s > 0), reverse=True):
        n, own = counts[size], tier(size)
        for t in range(own + 1):  # gaps of the longest windows first
            n = take(t, size, n)
            if not n:
                break
        if n:
            fit = widths[own] // size
            full, rest = divmod(n, fit)
            if full:
                put(own, (size,) * fit, widths[own] - size * fit, full)
            if rest:
                put(own, (size,) * rest, widths[own] - size * rest, 1)
    # windows of a shorter tier two by two, the fullest with the emptiest, up to whole contexts
    for t in range(len(widths) - 1, 0, -1):
        parts = sorted(((room, c, n) for room, cs in open_[t].items() for c, n in cs.items()), key=lambda x: (x[0], x[1]))
        a, b = 0, len(parts) - 1
        left = [n for *_, n in parts]
        while a < b or (a == b and left[a]):
            if a == b:
                pairs, odd = divmod(left[a], 2)
                if pairs:
                    put(t - 1, parts[a][1] * 2, widths[t - 1] - 2 * (widths[t] - parts[a][0]), pairs)
                if odd:
                    put(t - 1, parts[a][1], widths[t - 1] - (widths[t] - parts[a][0]), 1)
                break
            n = min(left[a], left[b])
            if n:
                put(t - 1, parts[a][1] + parts[b][1], widths[t - 1] - (widths[t] - parts[a][0]) - (widths[t] - parts[b][0]), n)
            left[a] -= n
            left[b] -= n
            a += not left[a]
            b -= not left[b]
    out = [(c, n) for cs in open_[0].values() for c, n in cs.items()]
    return [(c, n, tier(max(c))) for c, n in sorted(out, key=lambda x: (-sum(x[0]), x[0]))]


def pack(sized: DataFrame, capacity: int = 2_048, tiers: int = 4, step: int = 64, part_rows: int = PART_ROWS) -> DataFrame:
    """Where each item goes: (id, part, first_token, n_tokens, context, slot, tier, step).

    ``sized``: (id, n_tokens). An item larger than the capacity is split into full contexts and a rest; none other is
    split. Items of 0 or unknown size take no room and have no row; a repeated id is an item of its own. ``step`` contexts
    form one step, between which lengths are balanced. ``tier`` 0 holds items over half the capacity, 1 over a
    quarter, and so on.
    """
    items = shared_checkpoint(sized.where("n_tokens > 0")).withColumn("part", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {capacity})")))
    items = items.select("id", "part", (F.col("part") * capacity).alias("first_token"), F.least(F.col("n_tokens") - F.col("part") * capacity, F.lit(capacity)).alias("n"))
    # by size, at most capacity rows; a size of many items has as many parts as its number needs
    total = {r["n"]: r["k"] for r in items.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    parts = {n: -(-k // part_rows) for n, k in total.items()}
    several = {n: k for n, k in parts.items() if k > 1}
    salts = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)).cast("bigint") for kv in several.items() for x in kv]), F.col("n")), F.lit(1)) if several else F.lit(1)
    items = items.withColumn("_salt", F.pmod(F.xxhash64("id", "part"), salts).cast("int"))
    before = {n: np.array([0, k]) for n, k in total.items()}
    if several:
        by: dict[int, list[int]] = {n: [0] * k for n, k in several.items()}
        for n, salt, k in items.where(F.col("n").isin(list(several))).groupBy("n", "_salt").agg(F.count(F.lit(1)).alias("k")).collect():
            by[n][salt] = k
        before |= {n: np.concatenate([[0], np.cumsum(ks)]) for n, ks in by.items()}
    patterns = pack_histogram(total, capacity, tiers)
    first = np.concatenate([[0], np.cumsum([n for _, n, _ in patterns])]).astype(np.int64)
    groups = max(1, -(-int(first[-1]) // step))
    slots: dict[int, list[list[int]]] = defaultdict(lambda: [[0], [], [], []])  # ends, first context, slot, tier
    for p, (contents, n, tier) in enumerate(patterns):
        for slot, size in enumerate(contents):
            s = slots[size]
            s[0].append(s[0][-1] + n)
            s[1].append(int(first[p]))
            s[2].append(slot)
            s[3].append(tier)
    table = {n: [np.array(c) for c in s] for n, s in slots.items()}
    shared = sized.sparkSession.sparkContext.broadcast((before, table))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, table = shared.value
        for b in batches:
            n, salt, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("n", "_salt", "_rank"))
            context, slot, tier = (np.zeros(len(n), np.int64) for _ in range(3))
            for size in np.unique(n):
                m = np.flatnonzero(n == size)
                r = before[size][salt[m]] + rank[m] - 1
                ends, start, place, level = table[size]
                k = np.searchsorted(ends, r, "right") - 1
                context[m], slot[m], tier[m] = start[k] + r - ends[k], place[k], level[k]
            # the contexts, fullest pattern first, are dealt out to the steps in turn
            at = context % groups
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(context), pa.array(slot.astype(np.int32)), pa.array(tier.astype(np.int32)), pa.array(at)],
                names=["id", "part", "first_token", "n_tokens", "context", "slot", "tier", "step"],
            )

    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy("n", "_salt").orderBy("id", "part")))
    kind = sized.schema["id"].dataType.simpleString()
    return ranked.select("id", "part", "first_token", "n", "_salt", "_rank").mapInArrow(run, f"id {kind}, part bigint, first_token bigint, n_tokens bigint, context bigint, slot int, tier int, step bigint")
