"""Sleep: clustering of pending episodes by density, gists, facts, and the marks they leave."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import unfence

EPS, MIN_POINTS, BATCH = 0.3, 3, 100
FACTS = "array<struct<subject: string, predicate: string, object: string, confidence: double>>"


def pending_batch(episodes: DataFrame, limit: int = BATCH) -> DataFrame:
    """Up to ``limit`` pending episodes per user, the earliest by (ts, id): the size of one consolidation run."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    return episodes.where("user_id is not null and status = 'pending'").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)


def dbscan_labels(x: np.ndarray, eps: float = EPS, points: int = MIN_POINTS) -> np.ndarray:
    """Cluster of each row by cosine distance: 1, 2, ... in order of the first core row, noise -(row + 1). A row counts as its own
    neighbour; a zero row is at distance 1 from all. A border row joins the lowest adjacent cluster."""
    n = len(x)
    norm = np.linalg.norm(x, axis=1)
    unit = np.where(norm[:, None] > 0, x / np.where(norm > 0, norm, 1)[:, None], 0.0)
    near = 1 - unit @ unit.T <= eps + 1e-12
    np.fill_diagonal(near, (norm > 0) | (eps >= 1))
    core = near.sum(1) >= points
    label, found = np.zeros(n, int), 0
    for i in np.flatnonzero(core):
        if label[i]:
            continue
        found += 1
        todo = [i]
        label[i] = found
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & core & (label == 0)):
                label[j] = found
                todo.append(j)
    for i in np.flatnonzero(~core):
        by = label[near[i] & core]
        label[i] = by.min() if len(by) else -(i + 1)
    return label


def dbscan(batch: DataFrame, dim: int, eps: float = EPS, points: int = MIN_POINTS) -> DataFrame:
    """(user_id, id, cluster) of a pending batch (user_id, id, pos, embedding), each user's rows in order of ``pos``. A batch
    is bounded, so a group is small. An embedding of another length or with numbers that aren't finite counts as zero."""
    schema = pa.schema([("user_id", pa.string()), ("id", pa.string()), ("cluster", pa.int32())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        x = np.zeros((t.num_rows, dim))
        for i, v in enumerate(t["embedding"].to_pylist()):
            if v is not None and len(v) == dim and None not in v and np.isfinite(v).all():
                x[i] = v
        return pa.table([t["user_id"], t["id"], pa.array(dbscan_labels(x, eps, points).astype(np.int32))], schema=schema)

    return batch.select("user_id", "id", "pos", "embedding").groupBy("user_id").applyInArrow(run, "user_id string, id string, cluster int")


def gist_prompt(contents: Column) -> Column:
    """The episodes of a cluster as numbered lines; ``contents``: array of (ts, content) structs in order."""
    return F.array_join(F.transform(contents, lambda x, i: F.concat(F.lit("Episode "), (i + 1).cast("string"), F.lit(" (t="), F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm"), F.lit("): "), x["content"], F.lit("\n"))), "")


def parse_facts(reply: Column) -> Column:
    """The facts in a model's reply, with or without a code fence; null where it is no JSON list."""
    return F.from_json(unfence(reply), FACTS)


def set_where(df: DataFrame, ids: DataFrame, column: str, value: object) -> DataFrame:
    """``df`` with ``column`` set in the rows whose id is in ``ids``: a left join with distinct ids, copy on write."""
    mark = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return df.join(mark, "id", "left").withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).drop("_hit")


def delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def due(activity: DataFrame, pending: DataFrame, now: Column, idle_us: int = 15 * 60 * 1_000_000, most: int = 10) -> DataFrame:
    """Users due for consolidation: idle for more than ``idle_us`` (first), else with ``most`` pending episodes."""
    x = activity.join(pending, "user_id", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) > idle_us
    reason = F.when(idle, "inactivity_timeout").when(F.col("pending") >= most, "max_unconsolidated")
    return x.withColumn("reason", reason).where("reason is not null")


def tick(activity: DataFrame, pending: DataFrame, holds: DataFrame, now: Column, hold_us: int = 5 * 60 * 1_000_000) -> tuple[DataFrame, DataFrame]:
    """One pass of the scheduler over all known users: (jobs, holds).

    ``holds``: (user_id, until), users for whom a job was sent, until when no other is. Jobs are those due (``due``) and not held; each
    begins a hold of its own. A user who stays idle comes up again when the hold ends, with or without pending episodes.
    """
    held = holds.where(F.col("until") > now).select("user_id", "until")
    jobs = due(activity, pending, now).join(held.select("user_id"), "user_id", "left_anti").select("user_id", "reason", now.alias("at"))
    until = F.timestamp_add("MICROSECOND", F.lit(hold_us), F.col("at")).cast("timestamp_ntz")
    return jobs, held.unionByName(jobs.select("user_id", until.alias("until")))


def consolidated(episodes: DataFrame, batch: DataFrame, gists: DataFrame, decay: float = 0.95) -> DataFrame:
    """``episodes`` after a run: those of the ``batch`` (id, user_id, cluster) whose cluster has a gist and facts in ``gists`` (user_id, cluster,
    gist, facts) are consolidated and decayed; a cluster for which the provider failed (a null) stays as it was."""
    done = gists.where("gist is not null and facts is not null").select("user_id", "cluster")
    ids = batch.join(done, ["user_id", "cluster"], "left_semi").select("id")
    return set_where(set_where(episodes, ids, "status", "consolidated"), ids, "decay", decay)
