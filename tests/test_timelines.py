"""Histories, intervals and sessions against plain restatements, with chunks small enough that every key is hot."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators.history import amended, bitemporal_ledger, versions
from recollect.operators.intervals import Lists, covered, merge, merge_tree
from recollect.operators.sessions import gap_tree, sessions
from recollect.sources.tables import micros

T0 = datetime(2024, 1, 1)
US = 1_000_000


def at(s):
    return None if s is None else T0 + timedelta(seconds=s)


def base():
    return int((T0 - datetime(1970, 1, 1)).total_seconds()) * US


@pytest.mark.parametrize("target", [3, 1000])
def test_sessions(spark, target):
    r = random.Random(5)
    rows = [(f"e{i}", r.choice(["a", "a", "a", "b", "c", None]), at(r.randrange(4000)) if r.random() > 0.05 else None, 1) for i in range(300)]
    rows += rows[:40] + [(None, "a", at(5000), 1), (None, "a", at(5000), 1)]
    df = spark.createDataFrame(rows, "id string, user string, ts timestamp_ntz, gap_us int")
    tree = gap_tree(df, ["user"], "ts", "id", target).persist()
    seen = {(x[0] or i): x for i, x in enumerate(rows)}
    for gap in (0, 1, 5, 10, 17, 40, 100, 10_000):
        want = []
        for u in "abc":
            ts = sorted(x[2] for x in seen.values() if x[1] == u and x[2])
            cur = [ts[0]]
            for t in ts[1:] + [None]:
                if t is None or (t - cur[-1]).total_seconds() > gap:
                    want.append((u, cur[0], cur[-1], len(cur)))
                    cur = []
                cur.append(t)
        got = sessions(tree, gap * US).select("user", "session_start", "session_end", "n_events").collect()
        assert sorted(map(tuple, got)) == sorted(want), gap
    assert gap_tree(df.where("false"), ["user"], "ts", "id").count() == 0


def union(intervals):
    out = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def as_lists(lists):
    flat = [x for one in lists for x in one]
    return Lists(np.cumsum([0, *map(len, lists)]), np.array([s for s, _ in flat], np.int64), np.array([e for _, e in flat], np.int64))


def rows_of(x):
    return [[[s, e] for s, e in zip(x.start[a:b].tolist(), x.end[a:b].tolist())] for a, b in zip(x.off, x.off[1:])]


@pytest.mark.parametrize("seed", range(5))
def test_merge_of_lists(seed):
    r = random.Random(seed)
    some = lambda: union([(s := r.randrange(60), s + r.randrange(1, 9)) for _ in range(r.randrange(8))])
    a, b = [some() for _ in range(40)], [some() for _ in range(40)]
    both = merge(as_lists(a), as_lists(b))
    assert rows_of(both) == [union([*x, *y]) for x, y in zip(a, b)] == rows_of(merge(as_lists(b), as_lists(a)))
    sizes = [r.randrange(7) for _ in range(30)]
    groups = [[some() for _ in range(n)] for n in sizes]
    tree = merge_tree(np.cumsum([0, *sizes]), as_lists([x for g in groups for x in g]))
    assert rows_of(tree) == [union([i for x in g for i in x]) for g in groups]


@pytest.mark.parametrize("target", [4, 1000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_intervals(spark, target, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(160):
        s = r.randrange(600) if r.random() > 0.05 else None
        e = None if r.random() < 0.01 else (s or 0) + r.choice([-1, 0, 1, 2, 3, 5, 60])
        rows.append((r.choice(["a", "a", "b", None]), at(s), at(e), "x"))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "k string, f timestamp_ntz, t timestamp_ntz, kind string")
    want = []
    for k in "ab":
        iv = sorted((f, t or datetime.max) for x, f, t, _ in rows if x == k and f and (t is None or t > f))
        out = []
        for f, t in iv:
            if out and f <= out[-1][1]:
                out[-1][1] = max(out[-1][1], t)
            else:
                out.append([f, t])
        us = lambda x: None if x == datetime.max else round((x - datetime(1970, 1, 1)).total_seconds() * US)
        want += [(k, "period", us(f), us(t)) for f, t in out] + [(k, "gap", us(a[1]), us(b[0])) for a, b in zip(out, out[1:])]
    fan_in = 2 if seed == 2 else 256  # levels of tasks
    got = [tuple(x) for x in covered(df.repartition(7), ["k"], "f", "t", target, fan_in).select("k", "kind", "start_us", "end_us").collect()]
    key = lambda x: (*x[:3], x[3] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert covered(df.where("false"), ["k"], "f", "t").count() == 0


def held(rows, now):
    """The state at a recorded time, row by row."""
    best = {}
    for k, v, f, t, r in rows:
        if k is None or f is None or (t is not None and t <= f) or r > now:
            continue
        if (k, f) not in best or (r, t or 10**9, v or "") > best[k, f][0]:
            best[k, f] = ((r, t or 10**9, v or ""), v, t)
    out = set()
    for k in {k for k, _ in best}:
        fs = sorted(f for x, f in best if x == k)
        for f, n in zip(fs, [*fs[1:], None]):
            _, v, t = best[k, f]
            out.add((k, v, f, min([x for x in (t, n) if x is not None], default=None)))
    return out


@pytest.mark.parametrize("target", [4, 1000])
@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_ledger(spark, target, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(90):
        f = r.randrange(60) if r.random() > 0.03 else None
        t = None if r.random() < 0.5 else (f or 0) + r.choice([-2, 0, 3, 8, 20])
        rows.append((r.choice(["a", "a", "b", None]), r.choice(["x", "y", "z"]), f, t, r.randrange(50)))
    rows += rows[:15]
    df = spark.createDataFrame([(k, v, at(f), at(t), at(x), "q") for k, v, f, t, x in rows], "k string, v string, f timestamp_ntz, t timestamp_ntz, r timestamp_ntz, value string")
    led = bitemporal_ledger(df, ["k"], "v", "f", micros("t"), "r", target).persist()
    sec = lambda x: None if x is None else (x - base()) // US
    got = [(x["k"], x["value"], sec(x["valid_from_us"]), sec(x["valid_to_us"]), sec(x["recorded_from_us"]), sec(x["recorded_to_us"])) for x in led.collect()]
    assert len(got) == len(set(got))
    for now in (*range(0, 51, 3), 99):
        assert {x[:4] for x in got if x[4] <= now and (x[5] is None or x[5] > now)} == held(rows, now), now
    want = []
    state = sorted(held(rows, 99), key=lambda x: (x[0], x[2]))
    for k, v, f, t in state:
        if want and want[-1][:2] == [k, v] and want[-1][3] == f:
            want[-1][3] = t
        else:
            want.append([k, v, f, t])
    found = [[x["k"], x["value"], sec(x["valid_from_us"]), sec(x["valid_to_us"])] for x in versions(led).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    once = lambda x: {tuple(y) for y in x.drop("_chunk").collect()}
    stored = bitemporal_ledger(df.where(F.col("v") != "x"), ["k"], "v", "f", micros("t"), "r", target)
    more = amended(stored, df.where(F.col("v") != "x"), df.where(F.col("v") == "x"), ["k"], "v", "f", micros("t"), "r", target)
    assert once(more) == once(led) and once(amended(led, df, df.where("false"), ["k"], "v", "f", micros("t"), "r")) == once(led)
    assert versions(bitemporal_ledger(df.where("false"), ["k"], "v", "f", micros("t"), "r")).count() == 0
