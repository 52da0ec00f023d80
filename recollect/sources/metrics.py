"""Counters and histograms of the engine as lines of the text exposition format, computed from tables or observed on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _steps(start: float, width: float, count: int) -> list[float]:
    return [start + width * i for i in range(count)]


# The instruments, with the upper bounds of the histograms' buckets.
SECONDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
COUNTERS = [
    "ingest_episodes_total", "ingest_boundaries_detected_total", "retrieval_vector_searches_total", "retrieval_graph_searches_total", "dig_filtered_total",
    "consolidation_runs_total", "consolidation_triples_extracted_total", "consolidation_conflicts_detected_total", "consolidation_conflicts_resolved_total",
    "consolidation_episodes_consolidated_total", "http_requests_total",
]
HISTOGRAMS = {
    "ingest_latency_seconds": SECONDS, "retrieval_latency_seconds": SECONDS, "dig_score_distribution": _steps(-1.0, 0.25, 12),
    "knapsack_utilization_ratio": _steps(0.0, 0.1, 11), "knapsack_items_selected": _steps(0.0, 5.0, 10), "consolidation_latency_seconds": SECONDS,
    "consolidation_clusters_formed": _steps(0.0, 2.0, 10), "http_request_duration_seconds": SECONDS,
}


def _label(labels: list[str]) -> Column:
    return F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit('"')) for x in labels])


def counter(df: DataFrame, name: str, labels: list[str] = (), amount: Column | None = None) -> DataFrame:
    """(metric, labels, value): the rows of ``df``, or the sum of ``amount``, for each combination of ``labels``."""
    assert name in COUNTERS
    total = F.count(F.lit(1)).cast("double") if amount is None else F.coalesce(F.sum(amount), F.lit(0.0)).cast("double")
    return df.groupBy(*labels).agg(total.alias("value")).select(F.lit(name).alias("metric"), (_label(labels) if labels else F.lit("")).alias("labels"), "value")


def histogram(df: DataFrame, name: str, value: str, labels: list[str] = ()) -> DataFrame:
    """(metric, labels, value): cumulative buckets with the label ``le``, the sum and the count; nulls are no observations."""
    bounds = HISTOGRAMS[name]
    seen = df.where(F.col(value).isNotNull())
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    row = seen.groupBy(*labels).agg(*counts, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias("s"))
    own = _label(labels) if labels else F.lit("")
    le = lambda b: F.concat_ws(",", F.nullif(own, F.lit("")), F.lit(f'le="{b}"'))
    lines = [(f"{name}_bucket", le(f"{b:g}"), F.col(f"b{i}")) for i, b in enumerate(bounds)]
    lines += [(f"{name}_bucket", le("+Inf"), F.col("n")), (f"{name}_sum", own, F.col("s")), (f"{name}_count", own, F.col("n"))]
    one = [F.struct(F.lit(m).alias("metric"), x.alias("labels"), v.cast("double").alias("value")) for m, x, v in lines]
    return row.select(F.explode(F.array(*one)).alias("x")).select("x.*")


def exposition(lines: DataFrame) -> DataFrame:
    """One text line for each (metric, labels, value)."""
    shown = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    return lines.select(F.concat("metric", F.when(F.col("labels") != "", F.concat(F.lit("{"), "labels", F.lit("}"))).otherwise(""), F.lit(" "), shown).alias("line"))


def observed(df: DataFrame, name: str, **amounts: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counts taken while it is computed, without another pass: ``rows`` and an aggregate for each of ``amounts``."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in amounts.items()]), seen
