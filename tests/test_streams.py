"""Streams give what the batch operators give."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recollect.operators import segmentation
from recollect.streaming import activity


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    return stream.sparkSession.sql(f"select * from {name}").collect()


def test_rolling_surprisal(spark, tmp_path):
    r = random.Random(1)
    rows = [(u, i, " ".join(r.choice(["it", "extraordinary", "end.", "what?"]) for _ in range(r.randrange(1, 40))), datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(12) for u in ("a", "b")]
    schema = "user_id string, turn_id bigint, content string, ts timestamp"
    for k in range(3):
        spark.createDataFrame(rows[k * 8 : k * 8 + 8], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((x.user_id, x.turn_id, x.pos, x.s, x.above) for x in run(activity.rolling_surprisal(stream), "rolling"))
    batch = segmentation.rolling(spark.createDataFrame(rows, schema))
    assert got == sorted((x.user_id, x.turn_id, x.pos, x.s, x.above) for x in batch.collect())


def test_triggers(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", t + timedelta(seconds=i), "ingest") for i in range(10)] + [("b", t, "ingest"), ("b", t + timedelta(seconds=9), "consolidated"), ("c", t, "query")]
    late = [("z", t + timedelta(hours=2), "query")]
    schema = "user_id string, ts timestamp, kind string"
    for k, part in enumerate((rows, late, [("z", t + timedelta(hours=3), "query")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(x.user_id, x.reason, x.pending) for x in run(activity.triggers(stream), "triggers")}
    assert got == {("a", "max_unconsolidated", 10), ("a", "inactivity_timeout", 10), ("b", "inactivity_timeout", 0), ("c", "inactivity_timeout", 0)}


def test_session_windows(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + timedelta(minutes=15)), ("a", t + timedelta(minutes=30, microseconds=1)), ("b", t)]
    spark.createDataFrame(rows, "user_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id string, ts timestamp").parquet(str(tmp_path / "in"))
    q = activity.session_windows(stream).writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    batch = activity.session_windows(spark.createDataFrame(rows, "user_id string, ts timestamp")).collect()
    assert sorted((x.user_id, x.n_events) for x in batch) == [("a", 1), ("a", 2), ("b", 1)]


def test_append_episodes(spark, tmp_path):
    """A stream of turns, cut into segments, becomes stored episodes, each batch once."""
    t = datetime(2024, 1, 1)
    schema = "user_id string, turn_id bigint, content string, ts timestamp"
    spark.createDataFrame([("a", 1, "it is wonderful. what? " * 30, t), ("b", 2, "end.", t), ("b", 3, None, t)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def store(batch, number):
        segs = segmentation.segments(segmentation.rolling(batch))
        segmentation.episodes(segs).write.mode("append").parquet(str(tmp_path / "out"))

    for _ in range(2):  # a second start finds nothing new
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(store).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        got = spark.read.parquet(str(tmp_path / "out"))
        assert {x.user_id for x in got.collect()} == {"a", "b"} and got.count() == got.select("id").distinct().count() >= 2
    again = spark.readStream.schema(got.schema).parquet(str(tmp_path / "out"))
    q = activity.append_episodes(again, str(tmp_path / "copy"), str(tmp_path / "state2")).start()
    assert q.awaitTermination(100) and spark.read.parquet(str(tmp_path / "copy")).count() == got.count()
