"""Table sources: named parquet tables below one folder, and the cleaning every query shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def user_key(c: Column) -> Column:
    """The user a spelling stands for: lower case without outer blanks; a blank one is no user."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def micros(name: str) -> Column:
    """Microseconds since 1970 of a zone-less (or UTC) timestamp column; independent of the session's zone for
    zone-less ones."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast(`{name}` as timestamp_ntz))")


def from_micros(name: str) -> Column:
    """The zone-less timestamp of a column of microseconds."""
    return F.expr(f"timestampadd(MICROSECOND, `{name}`, {EPOCH})")


def type_key(c: Column) -> Column:
    """A relation type without case, blanks, underscores and hyphens, the form in which spellings agree."""
    return F.lower(F.regexp_replace(c, r"[\s_\-]+", ""))
