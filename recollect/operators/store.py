"""The episode store as a table: upsert, tolerant decoding, checks of uniqueness, layout on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.sources.tables import table, user_key

ZERO = {"content": "", "user_id": "", "status": "", "memory_type": "", "surprisal": 0.0, "importance": 0.0, "decay": 0.0, "token_count": 0}


def upsert(stored: DataFrame, incoming: DataFrame, order: list, key: str = "id") -> DataFrame:
    """Insert or replace by ``key``: of its rows the first in ``order`` stays; rows without a key get one from their values."""
    both = stored.unionByName(incoming) if incoming is not None else stored
    keyed = both.withColumn(key, F.coalesce(key, F.sha2(F.to_json(F.struct(*[c for c in both.columns if c != key])), 256)))
    w = Window.partitionBy(key).orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def episodes(spark: SparkSession, d: str, columns: list[str] | None = None, user: str | None = None) -> DataFrame:
    """The episodes, each id once, under short names; only the named columns are read. The rows of an id have one user, so with
    ``user`` all others are left out before the ids are compared."""
    e = table(spark, d, "episodes").where("id is not null")
    if user is not None:
        e = e.where(user_key(F.col("user_id")) == user)
    e = e.select(
        "id", user_key(F.col("user_id")).alias("user_id"), "content", "embedding", "ts", "memory_type", F.col("consolidation_status").alias("status"),
        F.col("surprisal_value").alias("surprisal"), F.col("importance_score").alias("importance"), F.col("decay_factor").alias("decay"), "token_count", "associated_entities",
    )
    need = dict.fromkeys(["id", "status", "decay", "importance", *(columns or e.columns)])
    rank = [F.coalesce("status", F.lit("")), F.desc(F.coalesce("decay", F.lit(-1.0))), F.coalesce("importance", F.lit(-1.0))]
    return upsert(e.select(*need), None, rank).select(*(columns or e.columns))


def decode(df: DataFrame) -> DataFrame:
    """Missing values as the zero of their type."""
    return df.select(*[F.coalesce(F.col(c), F.lit(ZERO[c])).alias(c) if c in ZERO else F.col(c) for c in df.columns])


def violations(df: DataFrame, unique: list[str]) -> DataFrame:
    """Keys that occur on several ids."""
    return df.groupBy(*unique).agg(F.countDistinct("id").alias("ids")).where("ids > 1")


def write_partitioned(df: DataFrame, path: str, buckets: int = 256) -> None:
    """Write partitioned by a hash of the user, sorted by user within files, so a user's scan reads one folder and skips
    row groups; salted by id, so that a hot user is spread over several files."""
    keyed = df.withColumn("user_bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    spread = keyed.repartition("user_bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("user_bucket", "user_id", "ts")
    spread.write.mode("overwrite").partitionBy("user_bucket").parquet(path)


def read_user(spark: SparkSession, path: str, user: str, buckets: int = 256) -> DataFrame:
    """One user's rows; the bucket prunes the folders, the equality is pushed to the scan."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(user)), F.lit(buckets)).cast("int")).first()[0]
    return spark.read.parquet(path).where((F.col("user_bucket") == bucket) & (F.col("user_id") == user))
