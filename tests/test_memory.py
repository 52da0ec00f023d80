"""The memory operators against plain restatements and by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import config, providers
from recollect.functions import text as tx
from recollect.operators import consolidation, graph, retrieval, segmentation, store
from recollect.sources import metrics, requests

T0 = "timestamp_ntz'2024-01-01 00:00:00'"


def knapsack(items, room):
    """Bisection for the price, then a greedy fill."""
    items = sorted(((v / w, i, w) for i, v, w in items), key=lambda x: (-x[0], x[1]))
    if room <= 0:
        return []
    lo, hi = 0.0, max([d for d, _, _ in items], default=0) + 1
    for _ in range(50):
        mid = (lo + hi) / 2
        if sum(w for d, _, w in items if d >= mid and d > 0) > room:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-9:
            break
    out = []
    for d, i, w in items:
        if d >= lo and w <= room:
            out.append(i)
            room -= w
    return out


def test_knapsack(spark):
    r = random.Random(6)
    rows, budgets, want = [], [], {}
    for k in range(60):
        items = [(f"i{j:02d}", r.choice([-3, 0, 1, 2, 7.5, 12]) * 1.0, r.randrange(1, 30)) for j in range(r.randrange(0, 14))]
        budget, forced = r.randrange(0, 120), r.choice([0, 0, 20, 130])
        rows += [(f"u{k}", *x) for x in items]
        budgets.append((f"u{k}", budget, forced))
        want[f"u{k}"] = knapsack(items, budget - forced)
    c = spark.createDataFrame(rows, "u string, id string, value double, weight bigint")
    b = spark.createDataFrame(budgets, "u string, budget int, forced int")
    got = {}
    for x in retrieval.knapsack(c, b, ["u"]).orderBy("u", "place").collect():
        got.setdefault(x.u, []).append(x.id)
    assert got == {k: v for k, v in want.items() if v}


def cut(words, least, most, able):
    out, cur = [], []
    for i, w in enumerate(words):
        if cur and (able[i] and w[-1] in ".!?" and len(cur) >= least or len(cur) >= most):
            out.append(" ".join(cur))
            cur = []
        cur.append(w)
    return out + [" ".join(cur)]


@pytest.mark.parametrize("target", [2, 100_000])
def test_segments(spark, target):
    r = random.Random(7)
    rows, want = [], []
    for u in ("a", "b"):
        ring = []
        for t in range(12):
            words = [r.choice(["it", "is", "wonderful.", "extraordinary", "what?", "no!", "end."]) for _ in range(r.choice([1, 5, 60, 130]))]
            rows.append((len(rows), u, "  ".join(words) + " \n", t))
            able = []
            for i, w in enumerate(words):
                s = (4 if i and words[i - 1][-1] in ".!?" else 1) + 1.5 * (len(w) > 8) + 2 * ("?" in w or "!" in w)
                ring = [*ring[-49:], s]
                able.append(s > np.mean(ring) + 1.1 * np.std(ring) + 1e-12)
            want += [(len(rows) - 1, i, c) for i, c in enumerate(cut(words, 6, 40, able))]
    rows += [(900, None, "x", 1), (901, "a", None, 1), (902, "a", "   ", 1)]
    df = spark.createDataFrame(rows, "turn_id bigint, user_id string, content string, t int").withColumn("ts", F.expr(f"timestampadd(SECOND, t, {T0})")).drop("t")
    rolled = segmentation.rolling(df, gamma=1.1, target=target)
    got = [(x.turn_id, x.seg, x.content) for x in segmentation.segments(rolled, 6, 40).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("target", [3, 100_000])
def test_conflicts(spark, target):
    r = random.Random(3)
    rows = [(i, r.choice("pq"), r.choice("xyz"), r.randrange(40), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, k string, v string, t int, confidence double").withColumn("at", F.expr(f"timestampadd(SECOND, t, {T0})"))
    got = {x.id: (x.closed_us, x.new_confidence) for x in graph.resolve_conflicts(df, ["k"], "v", "at", "id", 0.9, target).collect()}
    zero = 1_704_067_200_000_000
    for k in "pq":
        own = sorted((t, i, v) for i, x, v, t, _ in rows if x == k)
        for n, (_, i, v) in enumerate(own):
            later = next((t for t, _, v2 in own[n + 1 :] if v2 != v), None)
            assert got[i] == (None if later is None else zero + later * 1_000_000, 1.0 if later is None else 0.9)


def test_dbscan_cases():
    a, b = np.array([1, 0.0]), np.array([0, 1.0])
    x = np.array([b, a, a, a, b, b, a + b * 0.2, -a, 0 * a])
    assert consolidation.dbscan_labels(x, 0.1, 3).tolist() == [1, 2, 2, 2, 1, 1, 2, -8, -9]
    assert consolidation.dbscan_labels(np.zeros((0, 2))).tolist() == []
    assert consolidation.dbscan_labels(np.zeros((3, 2))).tolist() == [-1, -2, -3]


def test_text_functions(spark):
    df = spark.createDataFrame([("Did Ann Lee visit (Paris)?",), ("",), ("éééé",), ("a b c",), (None,)], "t string")
    got = df.select("t", tx.count_tokens(F.col("t")).alias("n"), tx.count_tokens(F.col("t"), 1).alias("w"), tx.entity_names(F.col("t")).alias("e"), tx.squeeze(F.col("t")).alias("s")).collect()
    assert got[0].e == ["Did", "Ann", "Lee", "Paris", "Did Ann", "Ann Lee"]
    assert [(x.n, x.w) for x in got[:3]] == [(6, 6), (0, 1), (2, 2)] and got[3].s == "a b c"
    assert got[4].n is None
    assert spark.range(1).select(consolidation.parse_facts(F.lit('```json\n[{"subject":"a","predicate":"b","object":"c","confidence":0.5}]\n```'))[0]["object"]).first()[0] == "c"


def test_traversal_and_fusion(spark):
    e = spark.createDataFrame([(i, "u", s, "p", o, 1.0 / (i + 1)) for i, (s, o) in enumerate([("a", "b"), ("c", "b"), ("c", "d"), ("d", "e"), ("a", "a")])], "id int, user_id string, src string, predicate string, dst string, confidence double")
    s = spark.createDataFrame([("q", "u", "a")], "query string, user_id string, node string")
    for hops, want in ((1, {0, 4}), (2, {0, 1, 4}), (3, {0, 1, 2, 4})):
        assert {x.id for x in graph.traverse(e, s, hops).collect()} == want
    g = graph.traverse(e, s, 3).select("query", F.col("confidence").alias("score"), "confidence", F.concat("src", "dst").alias("content"), F.col("src").alias("subject"), "predicate", F.col("dst").alias("object"), F.col("id").cast("string").alias("id"), F.col("id").alias("rank"))
    v = spark.createDataFrame([("q", "x", 1, 0.5, "hello")], "query string, id string, rank int, score double, content string")
    assert retrieval.merge_results(v, g, "reference").count() == 2 and retrieval.merge_results(v, g, "intended").count() == 5


def test_store_and_requests(spark, tmp_path):
    df = spark.createDataFrame([("1", "u1", "a", 1), ("1", "u1", "b", 2), (None, "u2", "c", 1)], "id string, user_id string, content string, v int")
    got = store.upsert(df, None, [F.desc("v")]).collect()
    assert {x.content for x in got} == {"b", "c"} and all(x.id for x in got)
    rows = store.upsert(df, None, [F.desc("v")]).withColumn("ts", F.current_timestamp())
    store.write_partitioned(rows, str(tmp_path / "e"))
    assert [x.content for x in store.read_user(spark, str(tmp_path / "e"), "u1").collect()] == ["b"]
    lines = spark.createDataFrame([('{"user_id":"u","content":"c","role":"user"}',), ('{"user_id":"u"}',), ("broken",)], "value string")
    assert requests.parse_ingest(lines).count() == 1
    q = spark.createDataFrame([('{"user_id":"u","query":"c","token_budget":0}',), ('{"user_id":"u","query":"c","token_budget":9}',)], "value string")
    assert sorted(x.token_budget for x in requests.parse_query(q, 4096).collect()) == [9, 4096]


def test_config(monkeypatch):
    monkeypatch.setenv("BUDGET", "99")
    s = config.load("token_budget: ${BUDGET}\ngamma: 0\nother: 3\ntop_k: 7 # comment\n")
    assert (s.token_budget, s.gamma, s.top_k) == (99, 1.5, 7)
    s = config.load("""
server:
  host: "0.0.0.0"
segmentation:
  gamma: 2.5   # sharper
  window_size: 0
knapsack:
  token_budget: $BUDGET
dig:
  min_score: -0.25
  fallback_enabled: false
consolidation:
  inactivity_timeout: 1h15m
  check_interval: 90s
  dbscan_min_points: x
retrieval:
  vector_top_k: "30"
""")
    assert (s.gamma, s.window, s.token_budget, s.min_gain, s.fallback, s.idle_seconds, s.check_seconds, s.min_points, s.top_k) == (2.5, 50, 99, -0.25, False, 4500, 90, 3, 30)
    assert config.load("") == config.Settings()


def test_metrics(spark):
    df = spark.createDataFrame([("a", -2.0), ("a", 0.0), ("b", 0.1), ("b", None), ("b", 9.0)], "kind string, v double")
    lines = {x.line for x in metrics.exposition(metrics.histogram(df, "dig_score_distribution", "v", ["kind"])).collect()}
    assert {'dig_score_distribution_bucket{kind="a",le="-1"} 1', 'dig_score_distribution_bucket{kind="a",le="0"} 2', 'dig_score_distribution_bucket{kind="b",le="+Inf"} 2', 'dig_score_distribution_sum{kind="b"} 9.1'} <= lines
    assert {x.line for x in metrics.exposition(metrics.counter(df, "http_requests_total")).collect()} == {"http_requests_total 5"}
    assert len(metrics.COUNTERS) + len(metrics.HISTOGRAMS) == 19
    kept, seen = metrics.observed(df, "m", high=F.max("v"))
    kept.collect()
    assert seen.get == {"rows": 5, "high": 9.0}


def test_scheduler(spark):
    at = lambda minutes: F.expr(f"{T0} + interval {minutes} minutes")
    activity = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(u).alias("user_id"), at(m).alias("last")) for u, m in (("idle", -20), ("edge", -15), ("busy", -1), ("calm", -1))])).alias("x")).select("x.*")
    pending = spark.createDataFrame([("busy", 10), ("calm", 9)], "user_id string, pending bigint")
    holds, got = spark.createDataFrame([], "user_id string, until timestamp_ntz"), []
    for m in (0, 1, 5):
        jobs, holds = consolidation.tick(activity, pending, holds, at(m))
        got.append({(x.user_id, x.reason) for x in jobs.collect()})
    assert got == [{("idle", "inactivity_timeout"), ("busy", "max_unconsolidated")}, {("edge", "inactivity_timeout")}, {("idle", "inactivity_timeout"), ("busy", "max_unconsolidated")}]


def test_triples_and_conflicts(spark):
    """One value contradicts another, is closed once, and the same value stays beside the new one."""
    now = F.expr(f"{T0} + interval 1 day")
    nodes = spark.createDataFrame([("Ann", "u")], "name string, user_id string").withColumn("created_at", F.expr(T0)).withColumn("last_accessed", F.expr(T0))
    edges = spark.createDataFrame([("1", "u", "Ann", "lives_in", "A", 1.0), ("2", "u", "Ann", "lives_in", "B", 0.5), ("3", "v", "Ann", "lives_in", "A", 1.0)], "id string, user_id string, src string, predicate string, dst string, confidence double").withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    triples = spark.createDataFrame([("u", "Ann", "lives_in", "B", 0.9, "e"), ("u", "Ann", "lives_in", "B", 0.9, "e"), ("u", None, "x", "y", 1.0, "e")], "user_id string, subject string, predicate string, object string, confidence double, source_ep_id string")
    closed = graph.close_conflicts(edges, triples, now)
    assert {(x.id, x.valid_to is None, x.confidence) for x in closed.collect()} == {("1", False, 0.95), ("2", True, 0.5), ("3", True, 1.0)}
    n, e = graph.insert_triples(nodes, closed, triples, now)
    assert {(x["name"], x.created_at == x.last_accessed) for x in n.collect()} == {("Ann", False), ("B", True)}
    rows = e.collect()
    assert len(rows) == 5 and len({x.id for x in rows}) == 5
    f = edges.select("id", "user_id", F.col("src").alias("subject"), "predicate", F.col("dst").alias("object"))
    assert {(x.id, x.others, x.first_other, x.last_other) for x in graph.conflicts(f, f).collect()} == {("1", 1, "B", "B"), ("2", 1, "A", "A")}
    assert graph.conflicts(f, f.where("false")).count() == 0


def test_failed_clusters_stay_pending(spark):
    e = spark.createDataFrame([(i, "pending", 1.0) for i in "abc"], "id string, status string, decay double")
    batch = spark.createDataFrame([("a", "u", 1), ("b", "u", -2), ("c", "u", 3)], "id string, user_id string, cluster int")
    gists = spark.createDataFrame([("u", 1, "g", ["f"]), ("u", -2, None, None), ("u", 3, "g", None)], "user_id string, cluster int, gist string, facts array<string>")
    assert {tuple(x) for x in consolidation.consolidated(e, batch, gists).collect()} == {("a", "consolidated", 0.95), ("b", "pending", 1.0), ("c", "pending", 1.0)}


def test_logs_and_truncation(spark):
    lines = spark.createDataFrame([(f'{{"ts":"2024-01-01T00:00:0{i}","level":"INFO","msg":"m{i}"' + (',"module":"api"' if i % 2 else "") + "}",) for i in range(5)] + [("broken",)], "value string")
    got = requests.log_tail(requests.log_entries(lines), "ts", "msg", 3).collect()
    assert [(x.msg, x.module, x.place) for x in sorted(got, key=lambda x: x.place)] == [("m2", "system", 1), ("m3", "api", 2), ("m4", "system", 3)]
    df = spark.createDataFrame([("éééé",), ("ééééé",), ("ab cdefgh ij",), ("a bcdefghijklm",), (None,)], "t string")
    assert [x[0] for x in df.select(tx.truncate(F.col("t"), 9)).collect()] == ["éééé", "éééé...", "ab cdefgh...", "a bcdefgh...", None]


def test_provider(spark):
    p = providers.Offline(8)
    df = spark.createDataFrame([("Ann lives in Paris",), (None,)], "t string")
    got = df.select(providers.embed(p, F.col("t")).alias("v"), providers.extract_facts(p, F.col("t")).alias("f"), providers.gain(p, F.lit("ann"), F.col("t")).alias("g")).collect()
    more = df.select(providers.token_probabilities(p, F.col("t")).alias("p"), providers.count_tokens(p, F.col("t")).alias("n"), providers.generate(p, F.lit("(t): One. Two.")).alias("g")).collect()
    assert [(x.token, x.log_prob, x.offset) for x in more[0].p][0] == ("Ann", -1.0, 0) and (more[0].n, more[1].n, more[1].p) == (4, None, None) and more[0].g == "One"
    assert len(got[0].v) == 8 and got[1].v is None and "Paris" in got[0].f and got[0].g == 1.0
