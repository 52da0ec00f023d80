"""JSON requests, jobs and logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INGEST = "user_id string, content string, role string"
QUERY = "user_id string, query string, token_budget int"
LOG_ROWS = 50


def parse_ingest(lines: DataFrame, column: str = "value") -> DataFrame:
    """Valid ingest requests of JSON lines: all three fields present and not empty; malformed lines are left out."""
    x = lines.withColumn("_r", F.from_json(column, INGEST)).select(*[c for c in lines.columns if c != column], "_r.*")
    return x.where("user_id <> '' and content <> '' and role <> ''")


def parse_query(lines: DataFrame, default_budget: int, column: str = "value") -> DataFrame:
    """Query requests; a budget that is missing or not positive is the default."""
    x = lines.withColumn("_r", F.from_json(column, QUERY)).select(*[c for c in lines.columns if c != column], "_r.*").where("user_id <> '' and query <> ''")
    return x.withColumn("token_budget", F.when(F.col("token_budget") > 0, F.col("token_budget")).otherwise(default_budget))


def job_payload(user: Column) -> Column:
    return F.to_json(F.struct(user.alias("user_id")))


def log_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON log lines as (ts, level, module, msg); a line without a module belongs to ``system``; malformed lines are left out."""
    x = lines.select(F.from_json(column, "ts timestamp_ntz, level string, module string, msg string").alias("r")).select("r.*")
    return x.where("msg is not null").withColumn("module", F.coalesce(F.nullif("module", F.lit("")), F.lit("system")))


def log_tail(logs: DataFrame, at: str, tie: str, rows: int = LOG_ROWS) -> DataFrame:
    """The last rows in order of arrival, numbered in ``place``: a top-k, never a full sort."""
    last = logs.orderBy(F.desc(at), F.desc(tie)).limit(rows)
    return last.withColumn("place", F.row_number().over(Window.orderBy(at, tie)))


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets (le inclusive; the last is +Inf), as one aggregation without a join."""
    counts = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    row = df.where(F.col(value).isNotNull()).agg(*counts, F.count(F.lit(1)).alias("total"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.coalesce(f"b{i}", F.lit(0)).alias("n")) for i, b in enumerate(bounds)]
    return row.select(F.explode(F.array(*pairs, F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))).alias("x")).select("x.le", "x.n")
