"""Chunks of hot keys with a halo: the last rows before each chunk, for frames that look back a fixed number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.chunks import TARGET_ROWS, time_chunks


def halo_chunks(df: DataFrame, keys: list[str], at: str, order: list[str], rows: int, target: int = TARGET_ROWS) -> DataFrame:
    """Add ``_chunk`` and ``_halo``. Within (keys, _chunk), ordered by ``order``, every row with ``_halo`` false is preceded by
    the ``rows`` rows that precede it in the whole key (fewer at its beginning); rows with ``_halo`` true are copies
    and must be dropped after the frame is computed. ``at`` is an integer that ``order`` begins with."""
    parts, several = time_chunks(df, keys, at, target)
    parts = parts.withColumn("_halo", F.lit(False))
    if not several:
        return parts
    # the last rows of each chunk serve all later chunks until a chunk has enough of its own
    back = Window.partitionBy(*keys, "_chunk").orderBy(*[F.desc(o) for o in order])
    tail = parts.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= rows)
    sizes = tail.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_have"))
    # a chunk has at least one row, so its tail serves no more than ``rows`` later ones: those before which that many have not come yet
    later = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, rows)
    sizes = sizes.withColumn("_next", F.collect_list(F.struct("_chunk", "_have")).over(later))
    needs = F.expr(f"filter(_next, (c, i) -> aggregate(slice(_next, 1, i), 0L, (s, b) -> s + b._have) < {rows})")
    sizes = sizes.withColumn("_to", F.transform(needs, lambda c: c["_chunk"])).select(*keys, "_chunk", "_to")
    copies = tail.drop("_back").join(sizes, [*keys, "_chunk"]).withColumn("_chunk", F.explode("_to")).drop("_to").withColumn("_halo", F.lit(True))
    return parts.unionByName(copies.select(*parts.columns))
