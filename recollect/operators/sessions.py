"""Sessions of activity, cut from a Cartesian tree over the gaps between consecutive events.

The tree of a key has a leaf for each moment with events and an inner node for each gap, above all nodes within the
stretch around it that has only smaller gaps. Each node knows its stretch (start, end, events), its own largest gap
and the gap that bounds it (its parent's). The sessions for a threshold are the nodes with
``gap <= threshold < parent_gap``: a filter on the tree, so one tree serves any number of thresholds without
another shuffle.

Hot keys are built chunk by chunk. A chunk closes every node bounded by known gaps on both sides; what touches its
borders remains as a short sequence of stretches (prefix and suffix maxima of the gaps, about log n of them), and
these sequences are joined per key by the same procedure.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.operators.chunks import TARGET_ROWS, time_chunks
from recollect.session import shared_checkpoint
from recollect.sources.tables import from_micros, micros


class _Tree:
    """Builds the tree of one sequence; ``closed``: nothing lies before or after it."""

    def __init__(self, closed: bool, node, rest):
        self.closed, self.node, self.rest = closed, node, rest
        self.stack: list[tuple] = []
        self.cur: tuple | None = None
        self.left: int | None = None  # the gap before the stack's lowest stretch; None: not known or none

    def add(self, start: int, end: int, n: int, own: int, done: bool) -> None:
        if self.cur is not None:
            self._gap(start - self.cur[1])
        self.cur = (start, end, n, own, done)

    def _gap(self, g: int) -> None:
        cur, stack = self.cur, self.stack
        while True:
            left = stack[-1][1] if stack else self.left
            if left is None and not self.closed:  # bounded by a gap of the chunk before
                self.rest(*cur, g)
                self.left = g
                return
            if not cur[4]:
                self.node(*cur[:4], g if left is None or g < left else left)
                cur = (*cur[:4], True)
            if stack and left <= g:
                (s, _, n, _, _), own = stack.pop()
                cur = (s, cur[1], n + cur[2], own, False)
                continue
            if not stack and not self.closed and left <= g:  # the stretch to the left remains open
                self.rest(*cur, g)
                self.left = g
                return
            stack.append((cur, g))
            return

    def finish(self) -> None:
        cur = self.cur
        if cur is None:
            return
        if not self.closed:
            for seg, g in self.stack:
                self.rest(*seg, g)
            self.rest(*cur, None)
        else:
            while True:
                left = self.stack[-1][1] if self.stack else None
                if not cur[4]:
                    self.node(*cur[:4], left)
                if not self.stack:
                    break
                (s, _, n, _, _), own = self.stack.pop()
                cur = (s, cur[1], n + cur[2], own, False)
        self.stack, self.cur, self.left = [], None, None


def _builder(keys: list[str], split: str | None, closed: bool, schema: pa.Schema):
    """A function over batches sorted by ``keys``, ``split`` and start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, split] if split else keys
        rows: list[tuple] = []
        key: tuple | None = None

        def node(s, e, n, own, parent):
            rows.append((*key, s, e, n, own, parent, False, None, False))

        def rest(s, e, n, own, done, gap):
            rows.append((*key, s, e, n, own, None, True, gap, done))

        tree = _Tree(closed, node, rest)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[] for _ in schema]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in (*names, "_s", "_e", "_n", "_own", "_done")]
            k = len(names)
            for row in zip(*cols):
                if row[:k] != key:
                    tree.finish()
                    key = row[:k]
                tree.add(*row[k:])
            if rows:
                yield flush()
        tree.finish()
        if rows:
            yield flush()

    return run


def _arrow(df: DataFrame, names: list[str]) -> tuple[pa.Schema, T.StructType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [df.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in ("_s", "_e", "_n", "_own", "_parent")]
    fields += [T.StructField("_rest", T.BooleanType()), T.StructField("_gap", T.LongType()), T.StructField("_done", T.BooleanType())]
    spark_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    return to_arrow_schema(spark_schema), spark_schema


def gap_tree(df: DataFrame, keys: list[str], at: str, id_col: str | None = None, target: int = TARGET_ROWS) -> DataFrame:
    """The Cartesian tree over the gaps between each key's consecutive events.

    Columns: ``keys``, ``start_us``, ``end_us``, ``n_events``, ``gap_us`` (largest gap inside; 0 in a leaf) and
    ``parent_gap_us`` (the smaller of the gaps around it; null at the root).

    - Rows with a null key or a null time are left out; an empty input gives an empty tree.
    - With ``id_col``, rows with the same id count once (the earliest by key and time, should they differ); rows
      without an id count each.
    - Events at the same moment form one leaf that counts them all; other columns are ignored.
    """
    src = df.select(*keys, micros(at).alias("_s"), *([F.col(id_col).alias("_id")] if id_col else []))
    if id_col:
        first = src.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.min(F.struct(F.col("_s").isNull().alias("_null"), "_s", *keys)).alias("_f"))
        src = first.select(*[F.col(f"_f.{k}").alias(k) for k in keys], F.col("_f._s").alias("_s")).unionByName(src.where(F.col("_id").isNull()).drop("_id"))
    src = src.where(F.col("_s").isNotNull())
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    points = src.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"))
    parts, several = time_chunks(points, keys, "_s", target)
    parts = parts.select(*keys, "_chunk", "_s", F.col("_s").alias("_e"), "_n", F.lit(0).cast("long").alias("_own"), F.lit(False).alias("_done"))
    out_cols = [*keys, F.col("_s").alias("start_us"), F.col("_e").alias("end_us"), F.col("_n").alias("n_events"), F.col("_own").alias("gap_us"), F.col("_parent").alias("parent_gap_us")]

    def build(rows: DataFrame, split: str | None, closed: bool) -> DataFrame:
        names = [*keys, split] if split else keys
        arrow, schema = _arrow(rows, names)
        return rows.repartition(*names).sortWithinPartitions(*names, "_s").mapInArrow(_builder(keys, split, closed, arrow), schema)

    if not several:
        return build(parts, None, True).select(*out_cols)
    level1 = shared_checkpoint(build(parts, "_chunk", False))
    joined = build(level1.where("_rest").select(*keys, "_s", "_e", "_n", "_own", "_done"), None, True)
    return level1.where("not _rest").select(*out_cols).unionByName(joined.select(*out_cols))


def sessions(tree: DataFrame, gap_us: int) -> DataFrame:
    """The sessions separated by gaps of more than ``gap_us``: the tree's nodes that hold no larger gap and are
    bounded by larger ones. A gap of exactly ``gap_us`` doesn't separate."""
    keys = [c for c in tree.columns if c not in ("start_us", "end_us", "n_events", "gap_us", "parent_gap_us")]
    cut = tree.where((F.col("gap_us") <= gap_us) & (F.col("parent_gap_us").isNull() | (F.col("parent_gap_us") > gap_us)))
    return cut.select(
        *keys,
        from_micros("start_us").alias("session_start"),
        from_micros("end_us").alias("session_end"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"),
        F.col("n_events").alias("n_events"),
    )
