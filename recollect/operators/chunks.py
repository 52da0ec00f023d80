"""Splitting of hot keys into time-ordered chunks.

A sequence operator (sessions, interval merging, histories) needs the rows of a key in time order. One key may
hold a third of all rows, so a window per key would put them into one task. ``time_chunks`` finds the keys with
more than ``target`` rows by one pre-aggregated count, cuts their time axis at approximate quantiles and labels
every row with its chunk; all other keys have the single chunk 0. The operators work on (key, chunk) and then
join neighbouring chunks by small summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import shared_checkpoint

TARGET_ROWS = 250_000
MAX_CUTS = 65_536
BROADCAST_ROWS = 20_000


def cut_points(df: DataFrame, keys: list[str], at: str, parts: int) -> DataFrame:
    """(keys, _cuts): the approximate quantiles of ``at`` that cut each key into ``parts`` parts, each within a tenth of a part. Above
    MAX_CUTS parts (16 thousand million rows of a key at the usual target) parts become larger instead of more."""
    n = min(MAX_CUTS, max(2, parts))
    return df.groupBy(*keys).agg(F.percentile_approx(at, [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("_cuts"))


def time_chunks(df: DataFrame, keys: list[str], at: str, target: int = TARGET_ROWS) -> tuple[DataFrame, bool]:
    """Add ``_chunk`` to ``df``; the second value says whether any key has several chunks.

    ``at`` is an integer column without nulls. Rows of one key with the same ``at`` share a chunk, chunks ascend with
    ``at``. The table of cuts has one row for each key above ``target`` rows, so at most rows / target; it is
    broadcast only when counted below BROADCAST_ROWS, else Spark plans the join. ``df`` is read twice, for the counts and for
    what follows, so it is checkpointed first.
    """
    df = shared_checkpoint(df)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target)
    found = hot.agg(F.count(F.lit(1)).alias("keys"), F.max("_n").alias("most")).first()
    if not found["keys"]:
        return df.withColumn("_chunk", F.lit(0)), False
    small = (lambda x: F.broadcast(x)) if found["keys"] <= BROADCAST_ROWS else (lambda x: x)
    part = df.join(small(hot.select(*keys)), keys, "left_semi").select(*keys, at)
    cuts = cut_points(part, keys, at, -(-found["most"] // target))
    out = df.join(small(cuts), keys, "left").withColumn(
        "_chunk", F.coalesce(F.size(F.filter(F.array_distinct("_cuts"), lambda c: c <= F.col(at))), F.lit(0))
    )
    # size(null) is -1 or null by configuration
    return out.withColumn("_chunk", F.greatest("_chunk", F.lit(0))).drop("_cuts"), True
