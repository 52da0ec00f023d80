"""History of changing attributes: a bitemporal ledger of valid and recorded time.

Statements about an attribute (key) say which value holds from ``valid_from`` on, possibly up to ``valid_to``, and when
that was recorded. They may arrive late, in any order, and again. The ledger says, for each moment of recording,
which value was held valid when: a late statement splits the interval it falls into and an amended one supersedes the
earlier row, whose recorded period then ends; nothing is overwritten.

The ledger is built by a sweep over valid time from the end of each key. The sweep keeps the statements that lie ahead
as a stack in which nearer ones were recorded later (a nearer one recorded earlier hides those behind it). What ends a
statement at the time it is recorded, and what later cuts it shorter, is read from that stack; each statement cuts
one predecessor when it arrives, so the ledger has at most two rows per statement. Hot keys are swept in
chunks of the time axis that receive the stack of the chunks after them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.operators.chunks import TARGET_ROWS, time_chunks
from recollect.sources.tables import micros

STACK = T.ArrayType(T.StructType([T.StructField("f", T.LongType()), T.StructField("r", T.LongType())]))


def _push(stack: list[tuple[int, int]], f: int, r: int) -> None:
    while stack and stack[-1][1] >= r:
        stack.pop()
    stack.append((f, r))


def _sweep(names: list[str], schema: pa.Schema):
    """Over batches sorted by ``names`` and descending valid_from; each row holds the statements of one moment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        stack: list[tuple[int, int]] = []
        for b in batches:
            out: list[tuple] = []
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in (*names, "_f", "_states", "_stack")]
            for *k, f, states, ahead in zip(*cols):
                if tuple(k) != key:
                    key, stack = tuple(k), [(x["f"], x["r"]) for x in ahead or ()]
                for i, s in enumerate(states):
                    r, until = s["r"], states[i + 1]["r"] if i + 1 < len(states) else None
                    j = len(stack) - 1
                    while j >= 0 and stack[j][1] > r:  # not yet recorded when this statement was
                        j -= 1
                    nxt = stack[j][0] if j >= 0 else None
                    for f2, r2 in stack[j + 1 :]:
                        if until is not None and r2 >= until:
                            break
                        if s["t"] is None or f2 < s["t"]:
                            out.append((*k, s["v"], f, _end(s["t"], nxt), r, r2))
                            r = r2
                        nxt = f2
                    out.append((*k, s["v"], f, _end(s["t"], nxt), r, until))
                _push(stack, f, states[0]["r"])
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    return run


def _end(t: int | None, nxt: int | None) -> int | None:
    return nxt if t is None else t if nxt is None else min(t, nxt)


def _moments(df: DataFrame, keys: list[str], value: str, valid_from: str, valid_to: Column, recorded: str) -> DataFrame:
    """One row per key and valid_from with its statements in order of recording, those that change nothing left out."""
    src = df.select(*keys, F.col(value).alias("_v"), micros(valid_from).alias("_f"), valid_to.alias("_t"), micros(recorded).alias("_r"))
    src = src.where(F.col("_f").isNotNull() & (F.col("_t").isNull() | (F.col("_t") > F.col("_f"))))
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    src = src.withColumn("_r", F.coalesce("_r", F.lit(-(1 << 62))))  # of unknown recording: before all others
    once = src.groupBy(*keys, "_f", "_r").agg(F.max(F.struct(F.coalesce("_t", F.lit((1 << 62))).alias("t"), F.col("_v").alias("v"))).alias("_x"))
    state = F.struct(F.col("_r").alias("r"), F.expr("nullif(_x.t, shiftleft(1L, 62))").alias("t"), F.col("_x.v").alias("v"))
    all_ = once.groupBy(*keys, "_f").agg(F.array_sort(F.collect_list(state)).alias("_states"))
    same = "get(_states, i - 1).t <=> x.t and get(_states, i - 1).v <=> x.v"
    return all_.withColumn("_states", F.expr(f"filter(_states, (x, i) -> i = 0 or not ({same}))"))


def bitemporal_ledger(df: DataFrame, keys: list[str], value: str, valid_from: str, valid_to: Column | None, recorded: str, target: int = TARGET_ROWS) -> DataFrame:
    """The ledger of the statements in ``df``.

    Columns: ``keys``, ``value``, ``valid_from_us``, ``valid_to_us`` (null: open), ``recorded_from_us``,
    ``recorded_to_us`` (null: still held), ``_chunk``.

    - ``valid_to``: microseconds, null for open; statements that end at or before their start are left out, as are
      those with a null key or start. A null recording time counts as earlier than all others.
    - Of statements with the same key, start and recording time the one with the latest end, then largest value,
      holds; a repeated statement changes nothing. A null value is a value. Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    moments = _moments(df, keys, value, valid_from, valid_to if valid_to is not None else F.lit(None).cast("long"), recorded)
    parts, several = time_chunks(moments, keys, "_f", target)
    names = [*keys, "_chunk"]
    if several:
        # each chunk's stack: its moments from the last to the first, a nearer one hiding those recorded later
        w = Window.partitionBy(*names).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
        first = parts.withColumn("_r0", F.expr("get(_states, 0).r")).withColumn("_before", F.min("_r0").over(w))
        seen = first.where(F.col("_before").isNull() | (F.col("_r0") < F.col("_before")))
        wk = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        heads = seen.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct(F.col("_f").alias("f"), F.col("_r0").alias("r")))).alias("_own"))
        ahead = heads.withColumn("_stack", F.array_sort(F.flatten(F.collect_list("_own").over(wk))))
        # far to near, without those hidden by a nearer one
        ahead = ahead.withColumn("_stack", F.expr("reverse(filter(_stack, (x, i) -> i = 0 or x.r < array_min(transform(slice(_stack, 1, i), y -> y.r))))"))
        parts = parts.join(ahead.select(*names, "_stack"), names, "left")
    else:
        parts = parts.withColumn("_stack", F.lit(None).cast(STACK))
    schema = T.StructType(
        [*[T.StructField(k, parts.schema[k].dataType) for k in names], T.StructField("value", df.schema[value].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("valid_from_us", "valid_to_us", "recorded_from_us", "recorded_to_us")]
    )
    swept = parts.repartition(*names).sortWithinPartitions(*names, F.desc("_f"))
    return swept.select(*names, "_f", "_states", "_stack").mapInArrow(_sweep(names, to_arrow_schema(schema)), schema)


def amended(ledger: DataFrame, statements: DataFrame, updates: DataFrame, keys: list[str], value: str, valid_from: str, valid_to: Column | None, recorded: str, target: int = TARGET_ROWS) -> DataFrame:
    """A stored ``ledger`` of ``statements`` after ``updates`` (statements that arrived since, early or late): the same as the ledger of
    both, but only the keys that occur in the updates are swept again; the rows of all others are taken over as they are.

    Rows that an update supersedes or splits keep their place in the ledger with an end of their recorded period, as in
    ``bitemporal_ledger``; without updates nothing changes.
    """
    touched = updates.select(*keys).dropna().distinct()
    cols = list(dict.fromkeys(updates.columns))
    again = statements.select(*cols).unionByName(updates.select(*cols)).join(touched, keys, "left_semi")
    kept = ledger.join(touched, keys, "left_anti").select(*ledger.columns)
    return kept.unionByName(bitemporal_ledger(again, keys, value, valid_from, valid_to, recorded, target).select(*ledger.columns))


def _islands(rows: DataFrame, by: list[str], extra: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("valid_from_us")
    touches = F.lag("value").over(w).eqNullSafe(F.col("value")) & (F.lag("valid_to_us").over(w) == F.col("valid_from_us"))
    marked = rows.withColumn("_i", F.when(touches & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1))
    marked = marked.withColumn("_i", F.sum("_i").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.max(F.coalesce("valid_to_us", F.lit(1 << 62)))
    return marked.groupBy(*by, "_i").agg(
        F.first("value").alias("value"), F.min("valid_from_us").alias("valid_from_us"),
        F.nullif(end, F.lit(1 << 62)).alias("valid_to_us"), *extra,
    )


def versions(ledger: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """The history as held at a moment of recording (default: now): consecutive rows of the same value whose periods
    touch are one version. Columns: the keys, ``value``, ``valid_from_us``, ``valid_to_us``.

    Chunks of hot keys are merged on their own first; then only their first and last versions meet the neighbours'.
    """
    inner = ("value", "valid_from_us", "valid_to_us", "recorded_from_us", "recorded_to_us", "_chunk")
    keys = [c for c in ledger.columns if c not in inner]
    if as_of_us is None:
        held = ledger.where(F.col("recorded_to_us").isNull())
    else:
        held = ledger.where((F.col("recorded_from_us") <= as_of_us) & (F.col("recorded_to_us").isNull() | (F.col("recorded_to_us") > as_of_us)))
    part = _islands(held.select(*keys, "_chunk", "value", "valid_from_us", "valid_to_us"), [*keys, "_chunk"], [])
    w = Window.partitionBy(*keys, "_chunk")
    part = part.withColumn("_n", F.max("_i").over(w))
    cols = [*keys, "value", "valid_from_us", "valid_to_us"]
    edge = (F.col("_i") == 1) | (F.col("_i") == F.col("_n"))
    return part.where(~edge).select(*cols).unionByName(_islands(part.where(edge).select(*cols), keys, []).select(*cols))
