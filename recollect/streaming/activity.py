"""Streams: activity and consolidation triggers, session windows, surprisal that runs on across messages."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.functions.text import fields, surprisal

TRIGGER = "user_id string, reason string, pending bigint, at timestamp"


def triggers(events: DataFrame, idle_minutes: int = 15, most: int = 10, hold_minutes: int = 5) -> DataFrame:
    """Consolidation jobs of a stream (user_id, ts, kind), ``kind`` 'ingest', 'query' or 'consolidated'.

    Keyed state holds a user's last activity (ingest or query), the number of pending episodes and when the last job was sent. A job is due
    when event time passes the last activity by more than ``idle_minutes`` (reason inactivity_timeout), with or without pending
    episodes, else when ``most`` episodes are pending. A job holds its user for ``hold_minutes``; who is still due then gets
    another. Episodes are pending until the end of a run is reported by 'consolidated', not until a job is sent.
    """
    hold, idle = hold_minutes * 60_000, idle_minutes * 60_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pending, sent = state.get if state.exists else (0, 0, -(1 << 60))
        out = []
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            if now - last > idle and now - sent >= hold:
                out.append((key[0], "inactivity_timeout", pending, pd.Timestamp(now, unit="ms")))
                sent = now
        else:
            for f in frames:
                for ts, kind in f.sort_values("ts")[["ts", "kind"]].itertuples(index=False):
                    ms = int(ts.timestamp() * 1000)
                    if kind == "consolidated":
                        pending = 0
                        continue
                    last = max(last, ms)
                    pending += kind == "ingest"
                    if pending >= most and ms - sent >= hold:
                        out.append((key[0], "max_unconsolidated", pending, ts))
                        sent = ms
        state.update((last, pending, sent))
        state.setTimeoutTimestamp(max(last + idle + 1, sent + hold, now + 1))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "reason", "pending", "at"])

    src = events.where("user_id is not null and ts is not null").withWatermark("ts", "1 minute")
    return src.groupBy("user_id").applyInPandasWithState(run, TRIGGER, "last bigint, pending bigint, sent bigint", "append", GroupStateTimeout.EventTimeTimeout)


def session_windows(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream (user_id, ts) by gaps of more than 15 minutes, with late events up to ``late``."""
    src = events.withWatermark("ts", late)
    s = src.groupBy("user_id", F.session_window("ts", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("session_end"))
    return s.select("user_id", F.col("w.start").alias("session_start"), "session_end", "n_events")


def rolling_surprisal(turns: DataFrame, window: int = 50, gamma: float = 2.5) -> DataFrame:
    """(user_id, turn_id, pos, s, above) of a stream of turns (user_id, turn_id, content, ts): the last ``window`` values
    are kept per user, so the threshold runs on across messages as in the batch operator. Turns of one batch are taken in order of
    (ts, turn_id)."""
    scored = F.transform("w", lambda x, i: surprisal(x, F.when(i > 0, F.get("w", i - 1))))
    src = turns.where("user_id is not null and ts is not null and content is not null").withColumn("w", fields(F.col("content"))).select("user_id", "turn_id", "ts", scored.alias("s"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "turn_id"])
        for turn, values in rows[["turn_id", "s"]].itertuples(index=False):
            for pos, s in enumerate(values):
                ring = [*ring[-(window - 1) :], int(2 * s)]
                n, a, b = len(ring), sum(ring), sum(x * x for x in ring)
                lead, spread = n * ring[-1] - a, n * b - a * a
                out.append((key[0], turn, pos, float(s), lead > 0 and lead * lead > spread * gamma * gamma))
        state.update((ring,))
        yield pd.DataFrame(out, columns=["user_id", "turn_id", "pos", "s", "above"])

    return src.groupBy("user_id").applyInPandasWithState(run, "user_id string, turn_id bigint, pos int, s double, above boolean", "ring array<int>", "append", GroupStateTimeout.NoTimeout)


def append_episodes(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of episodes to a parquet folder, each batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
