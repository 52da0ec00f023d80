"""Continuous periods and gaps of overlapping intervals, by a mergeable aggregate of disjoint interval lists.

The state is a sorted list of intervals that neither overlap nor touch. Each task that reads rows builds such lists of its own
rows, so only lists are shuffled. Two lists are merged in one linear pass; the lists of a key are merged two by two, the results
again, and so on: within a task up to FAN_IN lists, and where a key has more, by levels of tasks. The last list of a key is its
periods, the complement its gaps.

A key whose lists hold more than ``target`` intervals is cut into chunks along the time axis, so that no task holds all of it;
each chunk has a tree of its own, and chunks are joined by a carry, the largest end of all earlier chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recollect.operators.chunks import BROADCAST_ROWS, TARGET_ROWS, cut_points
from recollect.session import shared_checkpoint
from recollect.sources.tables import micros

OPEN = np.iinfo(np.int64).max
NEVER = np.iinfo(np.int64).min
FAN_IN = 256
BUFFER_ROWS = 1 << 20
PAIRS = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))


class Lists(NamedTuple):
    """Many lists in one: the i-th is ``start`` and ``end`` from ``off[i]`` to ``off[i + 1]``."""

    off: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def take(self, i: np.ndarray) -> Lists:
        size = self.off[i + 1] - self.off[i]
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.off[i] - off[:-1], size) + np.arange(off[-1])
        return Lists(off, self.start[at], self.end[at])


def _count_below(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x, where it would stand in the ascending ``values[lo:hi]``, before equal ones; by bisection, all at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        right = open_ & (values[np.minimum(mid, max(len(values) - 1, 0))] < x) if len(values) else open_ & False
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    return lo


def merge(a: Lists, b: Lists) -> Lists:
    """The union of the i-th list of ``a`` and the i-th of ``b``, for every i.

    The lists are interleaved by start. As each is disjoint and ascending, what is covered up to any place ends with the last
    interval of one of the two; an interval that starts beyond it begins a new one.
    """
    n = len(a.off) - 1
    of_a = np.repeat(np.arange(n), np.diff(a.off))
    where = np.arange(len(a.start)) + _count_below(b.start, b.off[of_a], b.off[of_a + 1], a.start)
    from_a = np.zeros(len(a.start) + len(b.start), bool)
    from_a[where] = True
    start = np.empty(len(from_a), np.int64)
    start[from_a], start[~from_a] = a.start, b.start
    group = np.empty(len(from_a), np.int64)
    group[from_a], group[~from_a] = of_a, np.repeat(np.arange(n), np.diff(b.off))
    seen_a = np.cumsum(from_a)
    seen_b = np.arange(1, len(from_a) + 1) - seen_a

    def reach(in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
        """The end of what is covered after so many intervals of each."""
        last = [np.where(k > x.off[group], np.append(x.end, NEVER)[k - 1], NEVER) for k, x in ((in_a, a), (in_b, b))]
        return np.maximum(*last)

    new = np.flatnonzero(start > reach(seen_a - from_a, seen_b - ~from_a)) if len(start) else np.zeros(0, np.int64)
    end = reach(seen_a, seen_b)[np.append(new[1:], len(start)) - 1] if len(new) else start[:0]
    return Lists(np.searchsorted(group[new], np.arange(n + 1)), start[new], end)


def merge_tree(first: np.ndarray, lists: Lists) -> Lists:
    """One list for each i, merged two by two from the lists from ``first[i]`` to ``first[i + 1]``."""
    while True:
        size = np.diff(first)
        if (size <= 1).all():
            break
        half = (size + 1) // 2
        to = np.concatenate([[0], np.cumsum(half)])
        left = np.repeat(first[:-1] - 2 * to[:-1], half) + 2 * np.arange(to[-1])
        last = np.repeat(first[1:], half)
        none = len(lists.off) - 1  # an empty list stands at the end for those without a partner
        more = lists._replace(off=np.append(lists.off, lists.off[-1]))
        lists, first = merge(lists.take(left), more.take(np.where(left + 1 < last, left + 1, none))), to
    more = lists._replace(off=np.append(lists.off, lists.off[-1]))
    return more.take(np.where(np.diff(first) > 0, first[:-1], len(lists.off) - 1))


def sweep(group: np.ndarray, start: np.ndarray, end: np.ndarray, groups: int) -> Lists:
    """The lists of the groups 0, 1, ... from intervals in any order."""
    order = np.lexsort((start, group))
    g, s, e = group[order], start[order], end[order]
    # ranks make ends of different groups comparable, so that one running maximum serves them all
    values, rank = np.unique(e, return_inverse=True)
    reach = values[np.maximum.accumulate(g * len(values) + rank) - g * len(values)] if len(g) else e
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return Lists(np.searchsorted(g[at], np.arange(groups + 1)), s[at], reach[np.append(at[1:], len(g)) - 1] if len(at) else e)


def _column(lists: Lists) -> pa.ListArray:
    kind = to_arrow_schema(T.StructType([T.StructField("x", PAIRS)])).field("x").type
    pairs = pa.StructArray.from_arrays([pa.array(lists.start, pa.int64()), pa.array(lists.end, pa.int64())], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(lists.off.astype(np.int32)), pairs, type=kind)


def _lists(col: pa.ListArray) -> Lists:
    off = col.offsets.to_numpy()
    s, e = col.flatten().flatten()
    return Lists((off - off[0]).astype(np.int64), s.to_numpy(), e.to_numpy())


def _partial(names: list[str], schema: pa.Schema):
    """Rows to one list per key and up to BUFFER_ROWS rows of a task."""

    def state(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        code = np.zeros(t.num_rows, np.int64)
        for k in names:
            d = t[k].combine_chunks()
            d = (d.chunk(0) if isinstance(d, pa.ChunkedArray) else d).dictionary_encode()
            _, code = np.unique(code * max(1, len(d.dictionary)) + d.indices.to_numpy(), return_inverse=True)
        _, at, code = np.unique(code, return_index=True, return_inverse=True)
        lists = sweep(code, t["_s"].to_numpy(), t["_e"].to_numpy(), len(at))
        keys = t.select(names).take(pa.array(at)).combine_chunks()
        return pa.RecordBatch.from_arrays([*[pa.concat_arrays(keys[k].chunks) for k in names], _column(lists)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= BUFFER_ROWS:
                yield state(held)
                held, n = [], 0
        if held:
            yield state(held)

    return run


def _tree(names: list[str], schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index("_lists"))
            first = col.offsets.to_numpy().astype(np.int64)
            merged = merge_tree(first - first[0], _lists(col.flatten()))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in names], _column(merged)], schema=schema)

    return run


def _cut(names: list[str], schema: pa.Schema):
    """The parts of each list that begin in the chunks between ``_cuts``, a row each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, cuts = _lists(b.column(b.schema.get_field_index("_list"))), b.column(b.schema.get_field_index("_cuts"))
            off = cuts.offsets.to_numpy().astype(np.int64)
            off -= off[0]
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.off))
            # chunks hold the starts from one cut on
            chunk = _count_below(cuts.flatten().to_numpy(), off[row], off[row + 1], lists.start + 1) - off[row]
            at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (chunk[1:] != chunk[:-1])])) if len(row) else row
            kept = b.take(pa.array(row[at]))
            yield pa.RecordBatch.from_arrays(
                [*[kept.column(kept.schema.get_field_index(k)) for k in names], pa.array(chunk[at].astype(np.int32)), _column(Lists(np.append(at, len(row)), lists.start, lists.end)), kept.column(kept.schema.get_field_index("_from"))],
                schema=schema,
            )

    return run


def _schema(df: DataFrame, names: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in names], *more])


def _merged(df: DataFrame, names: list[str]) -> DataFrame:
    """The lists of each combination of ``names`` merged, (names, _list)."""
    schema = _schema(df, names, T.StructField("_list", PAIRS))
    grouped = df.groupBy(*names).agg(F.collect_list("_list").alias("_lists"))
    return grouped.mapInArrow(_tree(names, to_arrow_schema(schema)), schema)


def partial_lists(src: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _list, _from): the lists of each task's rows (keys, _s, _e) and the task's number."""
    schema = _schema(src, keys, T.StructField("_list", PAIRS))
    return src.select(*keys, "_s", "_e").mapInArrow(_partial(keys, to_arrow_schema(schema)), schema).withColumn("_from", F.spark_partition_id())


def covered(df: DataFrame, keys: list[str], start: str, end: str, target: int = TARGET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Each key's continuous periods and the gaps between consecutive ones.

    Columns: ``keys``, ``kind`` (``period`` or ``gap``), ``start_us``, ``end_us`` (null: without end).

    - An interval is [start, end); a null end is open. Touching intervals belong together.
    - Rows with a null key or start, or an end at or before the start, are left out; repeated rows change nothing;
      an empty input gives an empty result; other columns are ignored.
    """
    src = df.select(*keys, micros(start).alias("_s"), F.coalesce(micros(end), F.lit(int(OPEN))).alias("_e"))
    src = src.where(F.col("_s").isNotNull() & (F.col("_e") > F.col("_s")))
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    # read once for the sizes and once for the tree
    lists = shared_checkpoint(partial_lists(src, keys))
    sizes = lists.groupBy(*keys).agg(F.sum(F.size("_list")).alias("_n"), F.count(F.lit(1)).alias("_m"))
    large = sizes.where((F.col("_n") > target) | (F.col("_m") > fan_in))
    found = large.agg(F.count(F.lit(1)).alias("keys"), F.max("_n").alias("rows"), F.max("_m").alias("lists")).first()
    if not found["keys"]:
        return _emit(_merged(lists, keys).withColumn("_next", F.lit(None).cast("long")), keys)
    small = F.broadcast if found["keys"] <= BROADCAST_ROWS else (lambda x: x)
    big = lists.join(small(large), keys)
    starts = big.where(F.col("_n") > target).select(*keys, F.explode("_list").alias("_x")).select(*keys, F.col("_x.s").alias("_s"))
    cuts = cut_points(starts, keys, "_s", -(-found["rows"] // target))
    big = big.join(small(cuts), keys, "left").withColumn("_cuts", F.coalesce(F.array_sort(F.array_distinct("_cuts")), F.array().cast("array<bigint>")))
    names = [*keys, "_chunk"]
    schema = _schema(lists, keys, T.StructField("_chunk", T.IntegerType()), T.StructField("_list", PAIRS), T.StructField("_from", T.IntegerType()))
    parts = big.select(*keys, "_list", "_cuts", "_from").mapInArrow(_cut(keys, to_arrow_schema(schema)), schema)
    # levels of tasks until the lists of a chunk are few enough for one
    most = found["lists"]
    while most > fan_in:
        most = -(-most // fan_in)
        level = parts.withColumn("_from", F.pmod(F.xxhash64("_from"), F.lit(most)).cast("int"))
        parts = _merged(level, [*names, "_from"])
    both = _join_chunks(_merged(parts, names), keys)
    rest = _merged(lists.join(small(large.select(*keys)), keys, "left_anti"), keys).withColumn("_next", F.lit(None).cast("long"))
    cols = [*keys, "_list", "_next"]
    return _emit(both.select(*cols).unionByName(rest.select(*cols)), keys)


def _emit(lists: DataFrame, keys: list[str]) -> DataFrame:
    """The intervals of each list and its complement, up to ``_next`` where a list goes on there."""
    rows = F.concat(
        F.transform("_list", lambda x: F.struct(F.lit("period").alias("kind"), x["s"].alias("s"), x["e"].alias("e"))),
        F.expr("transform(_list, (x, i) -> struct('gap' as kind, x.e as s, coalesce(get(_list, i + 1).s, _next) as e))"),
    )
    both = lists.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.kind", F.col("x.s").alias("start_us"), F.col("x.e").alias("end_us"))
    both = both.where((F.col("kind") == "period") | F.col("end_us").isNotNull())
    return both.withColumn("end_us", F.when(F.col("end_us") < int(OPEN), F.col("end_us")))


def _join_chunks(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Make the chunks' lists disjoint across chunks.

    One small row per chunk (first start, largest end) gives each chunk the reach of all earlier ones. Intervals
    within that reach are dropped or absorbed; the period that was open at the border ends with the last interval of
    the next chunks that begins within reach. Adds ``_next``, the start of the next chunk's first new period.
    """
    w = Window.partitionBy(*keys).orderBy("_chunk")
    ends = lists.select(*keys, "_chunk", F.expr("get(_list, size(_list) - 1).e").alias("_end"))
    carry = ends.withColumn("_reach", F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    # what a chunk adds to the period that reaches into it, and what begins within it
    x = lists.join(carry, [*keys, "_chunk"]).withColumn("_new", F.filter("_list", lambda i: F.col("_reach").isNull() | (i["s"] > F.col("_reach"))))
    # an interval inside the chunk that begins within reach may itself end later; what follows it is disjoint from it
    x = x.withColumn("_tail", F.array_max(F.transform(F.filter("_list", lambda i: i["s"] <= F.col("_reach")), lambda i: i["e"])))
    x = x.withColumn("_tail", F.greatest("_tail", "_reach")).drop("_list", "_reach")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    small = x.select(*keys, "_chunk", "_tail", F.expr("get(_new, 0).s").alias("_first"), F.size("_new").alias("_size"))
    # the end of a chunk's last period: the largest tail up to and with the next chunk that begins a new period
    small = small.withColumn("_run", F.count(F.when(F.col("_size") > 0, 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    run_end = small.groupBy(*keys, "_run").agg(F.max("_tail").alias("_last"))
    small = small.withColumn("_next", F.first("_first", ignorenulls=True).over(after))
    own = small.where(F.col("_size") > 0).select(*keys, "_chunk", "_next", (F.col("_run") + 1).alias("_run"))
    own = own.join(run_end, [*keys, "_run"], "left").drop("_run")
    out = x.drop("_tail").join(own, [*keys, "_chunk"])
    return out.withColumn(
        "_list",
        F.expr("transform(_new, (x, i) -> if(i = size(_new) - 1, struct(x.s as s, greatest(x.e, _last) as e), x))"),
    ).drop("_new", "_last")
