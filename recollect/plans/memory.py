"""Queries of the memory engine's own operators, by inventory number, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.functions import vectors as vx
from recollect.operators import consolidation as con
from recollect.operators import graph, retrieval, segmentation, store
from recollect.session import shared_checkpoint
from recollect.sources import metrics, requests
from recollect.sources.tables import from_micros, micros, table, type_key, user_key

DIM = 64
AS_OF = "2015-06-01 00:00:00"
NOW = "2016-05-01 00:00:00"
TICK = "2016-03-25 09:45:00"  # some users are active, with pending episodes
NOW_S = 1_462_060_800
BUDGET = 512

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def ntz(s: str):
    return F.expr(f"timestamp_ntz'{s}'")


SECOND = "yyyy-MM-dd HH:mm:ss"
E = """e AS (SELECT * FROM (SELECT id, nullif(lower(trim(user_id)), '') AS user_id, content, embedding, ts, memory_type, consolidation_status AS status,
  surprisal_value AS surprisal, importance_score AS importance, decay_factor AS decay, token_count, associated_entities,
  row_number() OVER (PARTITION BY id ORDER BY coalesce(consolidation_status, ''), coalesce(decay_factor, -1) DESC, coalesce(importance_score, -1)) AS rn
  FROM episodes WHERE id IS NOT NULL) WHERE rn = 1)"""
T = """t AS (SELECT DISTINCT turn_id, nullif(lower(trim(user_id)), '') AS user_id, role, content, ts FROM turns WHERE turn_id IS NOT NULL)"""
V = """v AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM e WHERE user_id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
Q = """q AS (SELECT user_id, arg_min(x, id) AS vector, arg_min(coalesce(content, ''), id) AS text FROM v GROUP BY user_id)"""
N = """n AS (SELECT id, nullif(lower(trim(user_id)), '') AS user_id, max(trim(name)) AS name, min(created_at) AS created_at, max(last_accessed) AS last_accessed
  FROM entities WHERE id IS NOT NULL AND user_id IS NOT NULL AND trim(user_id) <> '' GROUP BY ALL)"""
R = """r AS (SELECT id, nullif(lower(trim(user_id)), '') AS user_id, from_entity_id AS src, to_entity_id AS dst, lower(regexp_replace(relation_type, '[\\s_\\-]+', '', 'g')) AS predicate,
  coalesce(confidence, 0) AS confidence, valid_from, valid_to, transaction_time, source_ep_id FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY transaction_time DESC, coalesce(valid_to, TIMESTAMP '9999-01-01') DESC) AS rn FROM relationships WHERE id IS NOT NULL) WHERE rn = 1)"""
A = f"""a AS (SELECT * FROM r WHERE src IS NOT NULL AND dst IS NOT NULL AND user_id IS NOT NULL AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}'))"""
G = """g AS (SELECT a.id, a.user_id, s.name AS src, a.predicate, o.name AS dst, a.confidence FROM a JOIN n s ON a.src = s.id AND a.user_id = s.user_id JOIN n o ON a.dst = o.id AND a.user_id = o.user_id)"""


def eps(spark, d, *cols) -> DataFrame:
    return store.episodes(spark, d, list(cols))


def turns(spark, d) -> DataFrame:
    t = table(spark, d, "turns").where("turn_id is not null").select("turn_id", user_key(F.col("user_id")).alias("user_id"), "role", "content", "ts")
    return t.distinct()


def usable(spark, d, *cols) -> DataFrame:
    e = eps(spark, d, "id", "user_id", "embedding", *cols)
    return e.where(F.col("user_id").isNotNull() & vx.usable(F.col("embedding"), DIM))


def questions(spark, d) -> DataFrame:
    """One query per user: the usable episode with the smallest id."""
    q = usable(spark, d, "content").groupBy("user_id").agg(F.min_by(F.struct("embedding", "content"), "id").alias("x"))
    return q.select(F.col("user_id").alias("query"), "user_id", F.col("x.embedding").alias("vector"), F.coalesce("x.content", F.lit("")).alias("text"))


def nodes(spark, d) -> DataFrame:
    n = table(spark, d, "entities").where("id is not null").select("id", user_key(F.col("user_id")).alias("user_id"), F.trim("name").alias("name"), "created_at", "last_accessed")
    return n.where("user_id is not null").groupBy("id", "user_id").agg(F.max("name").alias("name"), F.min("created_at").alias("created_at"), F.max("last_accessed").alias("last_accessed"))


def relations(spark, d) -> DataFrame:
    r = table(spark, d, "relationships").where("id is not null")
    r = store.upsert(r, None, [F.desc("transaction_time"), F.desc(F.coalesce("valid_to", ntz("9999-01-01 00:00:00")))])
    return r.select("id", user_key(F.col("user_id")).alias("user_id"), F.col("from_entity_id").alias("src"), F.col("to_entity_id").alias("dst"), type_key(F.col("relation_type")).alias("predicate"),
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "valid_from", "valid_to", "transaction_time", "source_ep_id")


def active(spark, d) -> DataFrame:
    return relations(spark, d).where("src is not null and dst is not null and user_id is not null").where(graph.valid_at(ntz(AS_OF)))


def facts(spark, d) -> DataFrame:
    """Valid facts with the names of both ends."""
    n = nodes(spark, d).select("id", "user_id", "name")
    a = active(spark, d)
    s, o = n.toDF("src", "user_id", "src_name"), n.toDF("dst", "user_id", "dst_name")
    return a.join(s, ["src", "user_id"]).join(o, ["dst", "user_id"]).select("id", "user_id", F.col("src_name").alias("src"), "predicate", F.col("dst_name").alias("dst"), "confidence")


# --- sources and sinks


@query("op01_ingest_requests", f"WITH {T} SELECT turn_id, user_id, content, role FROM t WHERE user_id <> '' AND content <> '' AND role <> ''")
def op01(spark, d):
    lines = turns(spark, d).select("turn_id", F.to_json(F.struct("user_id", "content", "role")).alias("value"))
    return requests.parse_ingest(lines).select("turn_id", "user_id", "content", "role")


@query("op02_query_requests", f"WITH {T} SELECT turn_id, user_id, content AS query, CASE WHEN turn_id % 3 = 0 THEN 1024 ELSE 4096 END AS token_budget FROM t WHERE user_id <> '' AND content LIKE '%?%'")
def op02(spark, d):
    budget = F.when(F.col("turn_id") % 3 == 0, 1024).when(F.col("turn_id") % 3 == 1, 0)
    lines = turns(spark, d).where(F.col("content").contains("?")).select("turn_id", F.to_json(F.struct("user_id", F.col("content").alias("query"), budget.alias("token_budget"))).alias("value"))
    return requests.parse_query(lines, 4096).select("turn_id", "user_id", "query", F.col("token_budget").cast("int").alias("token_budget"))


@query("op04_upsert_episodes", f"""WITH {E}, i AS (SELECT id, 'restored' AS status, 0.5::DOUBLE AS decay, coalesce(token_count, 0) + 1 AS token_count FROM e WHERE ts >= TIMESTAMP '2016-03-20'
  UNION ALL SELECT 'new-' || id, 'pending', 1.0, 7 FROM e WHERE ts < TIMESTAMP '2016-03-03')
SELECT id, status, decay, token_count FROM i UNION ALL SELECT id, status, decay, coalesce(token_count, -1) FROM e ANTI JOIN i USING (id)""")
def op04(spark, d):
    """Later versions of some episodes replace the stored ones, others are new."""
    e = eps(spark, d, "id", "status", "decay", "token_count", "ts")
    again = e.where(F.col("ts") >= ntz("2016-03-20 00:00:00")).select("id", F.lit("restored").alias("status"), F.lit(0.5).alias("decay"), (F.coalesce("token_count", F.lit(0)) + 1).alias("token_count"))
    new = e.where(F.col("ts") < ntz("2016-03-03 00:00:00")).select(F.concat(F.lit("new-"), "id").alias("id"), F.lit("pending").alias("status"), F.lit(1.0).alias("decay"), F.lit(7).alias("token_count"))
    stored = e.select("id", "status", "decay", F.coalesce("token_count", F.lit(-1)).alias("token_count"), F.lit(0).alias("_v"))
    return store.upsert(stored, again.unionByName(new).withColumn("_v", F.lit(1)), [F.desc("_v")]).drop("_v")


@query("op05_decode", f"WITH {E} SELECT id, coalesce(content, '') AS content, coalesce(user_id, '') AS user_id, coalesce(status, '') AS status, coalesce(surprisal, 0) AS surprisal, coalesce(token_count, 0) AS token_count FROM e")
def op05(spark, d):
    return store.decode(eps(spark, d, "id", "content", "user_id", "status", "surprisal", "token_count"))


@query("op06_unique_names", f"WITH {N} SELECT lower(left(name, 5)) AS name, user_id, count(DISTINCT id) AS ids FROM n GROUP BY ALL HAVING count(DISTINCT id) > 1")
def op06(spark, d):
    """Names and users are unique in the data, so the check is of the names' first five letters, which are not."""
    return store.violations(nodes(spark, d).withColumn("name", F.lower(F.left("name", F.lit(5)))), ["name", "user_id"])


_TRIPLES = """tr AS (SELECT user_id, src AS subject, predicate, CASE WHEN id < '8' THEN dst ELSE 'new ' || dst END AS object, confidence, id AS source_ep_id FROM g WHERE confidence >= 0.5)"""


def _triples(spark, d) -> DataFrame:
    """What a run might extract: facts of some confidence, half of them about things not known yet."""
    f = facts(spark, d).where("confidence >= 0.5")
    thing = F.when(F.col("id") < "8", F.col("dst")).otherwise(F.concat(F.lit("new "), "dst"))
    return f.select("user_id", F.col("src").alias("subject"), "predicate", thing.alias("object"), "confidence", F.col("id").alias("source_ep_id"))


def _written(spark, d):
    n, e = nodes(spark, d).drop("id"), active(spark, d).withColumn("decay_rate", F.lit(1.0))
    return graph.insert_triples(n, e, _triples(spark, d), ntz(NOW))


@query("op07_triple_sink", f"""WITH {N}, {R}, {A}, {G}, {_TRIPLES}, x AS (SELECT name, user_id, created_at, last_accessed FROM n UNION ALL SELECT subject, user_id, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' FROM tr
  UNION ALL SELECT object, user_id, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' FROM tr)
SELECT name, user_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(max(last_accessed), '%Y-%m-%d %H:%M:%S') AS last_accessed FROM x GROUP BY name, user_id""")
def op07(spark, d):
    """The nodes after the triples are written."""
    n, _ = _written(spark, d)
    return n.select("name", "user_id", F.date_format("created_at", SECOND).alias("created_at"), F.date_format("last_accessed", SECOND).alias("last_accessed"))


@query("op07_triple_edges", f"""WITH {N}, {R}, {A}, {G}, {_TRIPLES}, x AS (SELECT user_id, predicate, confidence, valid_from, valid_to FROM a UNION ALL SELECT user_id, predicate, confidence, TIMESTAMP '{NOW}', NULL FROM tr)
SELECT user_id, predicate, count(*) AS edges, count(*) FILTER (valid_from = TIMESTAMP '{NOW}' AND valid_to IS NULL) AS written, round(sum(confidence), 5) AS confidence FROM x GROUP BY ALL""")
def op07e(spark, d):
    _, e = _written(spark, d)
    new = F.count_if((F.col("valid_from") == ntz(NOW)) & F.col("valid_to").isNull())
    return e.groupBy("user_id", "predicate").agg(F.count(F.lit(1)).alias("edges"), new.alias("written"), F.round(F.sum("confidence"), 5).alias("confidence"))


@query("op11_jobs", f"WITH {E} SELECT '{{\"user_id\":\"' || user_id || '\"}}' AS payload FROM e WHERE user_id IS NOT NULL AND status = 'pending' GROUP BY user_id HAVING count(*) >= 10")
def op11(spark, d):
    n = eps(spark, d, "user_id", "status").where("user_id is not null and status = 'pending'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n >= 10").select(requests.job_payload(F.col("user_id")).alias("payload"))


@query("op12_embed", f"WITH {T} SELECT turn_id, 64 AS size, regexp_matches(content, '[\\p{{L}}\\p{{N}}_]') AS unit FROM t WHERE content IS NOT NULL")
def op12(spark, d):
    """The sizes of the vectors, and whether they have length 1, as all with a word have."""
    from recollect import providers

    t = turns(spark, d).where("content is not null").select("turn_id", providers.embed(providers.Offline(DIM), F.col("content")).alias("v"))
    return t.select("turn_id", F.size("v").alias("size"), (F.abs(vx.norm(F.col("v")) - 1) < 1e-3).alias("unit"))


@query("op96_token_probabilities", f"WITH {T}, {{W}} SELECT turn_id, pos AS \"offset\", word AS token, -s::DOUBLE AS log_prob FROM w")
def op96(spark, d):
    from recollect import providers

    t = turns(spark, d).where("user_id is not null and ts is not null and content is not null")
    return t.select("turn_id", F.explode(providers.token_probabilities(providers.Offline(DIM), F.col("content"))).alias("x")).select("turn_id", F.col("x.offset").cast("long").alias("offset"), "x.token", "x.log_prob")


@query("op96_count_tokens", f"WITH {T} SELECT turn_id, CASE WHEN content = '' THEN 0 ELSE greatest(1, strlen(content) // 4) END AS n FROM t WHERE content IS NOT NULL")
def op96c(spark, d):
    from recollect import providers

    return turns(spark, d).where("content is not null").select("turn_id", providers.count_tokens(providers.Offline(DIM), F.col("content")).cast("long").alias("n"))


# --- filters and projections


@query("op14_tenant_filter", f"WITH {E} SELECT id, content FROM e WHERE user_id = 'user_0000101'")
def op14(spark, d):
    return store.episodes(spark, d, ["id", "content"], "user_0000101")


@query("op15_pending_filter", f"WITH {E} SELECT id FROM e WHERE user_id = 'user_0000007' AND status = 'pending'")
def op15(spark, d):
    return store.episodes(spark, d, ["id", "status"], "user_0000007").where("status = 'pending'").select("id")


@query("op16_valid_edges", f"WITH {R}, {A} SELECT id, user_id, predicate FROM a")
def op16(spark, d):
    return active(spark, d).select("id", "user_id", "predicate")


@query("op17_seed_edges", f"WITH {N}, {R}, {A}, {G}, s AS (SELECT user_id, min(name) AS name FROM n GROUP BY user_id) SELECT id FROM g SEMI JOIN s ON g.user_id = s.user_id AND g.src = s.name")
def op17(spark, d):
    seeds = nodes(spark, d).groupBy("user_id").agg(F.min("name").alias("src"))
    return facts(spark, d).join(seeds, ["user_id", "src"], "left_semi").select("id")


@query("op21_fact_text", f"WITH {N}, {R}, {A}, {G} SELECT id, src || ' ' || predicate || ' ' || dst AS fact FROM g")
def op21(spark, d):
    return facts(spark, d).select("id", graph.fact_text("src", "predicate", "dst").alias("fact"))


@query("op22_content", f"""WITH {E}, {N}, {R}, {A}, {G} SELECT id, content FROM e WHERE content <> '' UNION ALL SELECT id, src || ' ' || predicate || ' ' || dst || '. ' AS content FROM g""")
def op22(spark, d):
    """The content of results: an episode's own, or that of a fact."""
    e = eps(spark, d, "id", "content").where("content <> ''")
    return e.unionByName(facts(spark, d).select("id", graph.fact_sentence("src", "predicate", "dst").alias("content")))


@query("op23_confidence", "SELECT id, coalesce(try_cast(confidence::VARCHAR AS DOUBLE), 0) AS confidence FROM relationships")
def op23(spark, d):
    return table(spark, d, "relationships").select("id", F.coalesce(F.expr("try_cast(cast(confidence as string) as double)"), F.lit(0.0)).alias("confidence"))


_OLD = f"WITH {E}, o AS (SELECT id FROM e WHERE ts < TIMESTAMP '2016-04-01')"


def _old(e: DataFrame) -> DataFrame:
    return e.where(F.col("ts") < ntz("2016-04-01 00:00:00")).select("id")


@query("op24_mark_consolidated", f"{_OLD} SELECT e.id, CASE WHEN o.id IS NOT NULL THEN 'consolidated' ELSE status END AS status FROM e LEFT JOIN o ON e.id = o.id")
def op24(spark, d):
    e = eps(spark, d, "id", "ts", "status")
    return con.set_where(e, _old(e), "status", "consolidated").select("id", "status")


@query("op25_set_decay", f"{_OLD} SELECT e.id, CASE WHEN o.id IS NOT NULL THEN 0.95 ELSE decay END::DOUBLE AS decay FROM e LEFT JOIN o ON e.id = o.id")
def op25(spark, d):
    e = eps(spark, d, "id", "ts", "decay")
    return con.set_where(e, _old(e), "decay", 0.95).select("id", "decay")


@query("op26_delete", f"{_OLD} SELECT id FROM e ANTI JOIN o USING (id)")
def op26(spark, d):
    e = eps(spark, d, "id", "ts")
    return con.delete(e, _old(e)).select("id")


# --- joins over the graph


@query("op27_one_hop", f"WITH {N}, {R}, {A}, {G} SELECT * FROM (SELECT user_id, src, predicate, dst, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY user_id, src ORDER BY confidence DESC, id) AS place FROM g)")
def op27(spark, d):
    w = Window.partitionBy("user_id", "src").orderBy(F.desc("confidence"), "id")
    return facts(spark, d).select("user_id", "src", "predicate", "dst", F.round("confidence", 6).alias("confidence"), F.row_number().over(w).alias("place"))


_HOPS = """ends AS (SELECT user_id, src AS node, dst AS other FROM g UNION SELECT user_id, dst, src FROM g),
near AS (SELECT user_id, node FROM seeds UNION SELECT s.user_id, x.other FROM seeds s JOIN ends x ON s.user_id = x.user_id AND s.node = x.node),
hops AS (SELECT DISTINCT g.* FROM g JOIN near ON g.user_id = near.user_id AND (g.src = near.node OR g.dst = near.node))"""


@query("op28_traverse", f"""WITH {N}, {R}, {A}, {G}, seeds AS (SELECT user_id, min(name) AS node FROM n GROUP BY user_id), {_HOPS}
SELECT user_id, id, src, predicate, dst, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, id) AS place FROM hops) WHERE place <= 50""")
def op28(spark, d):
    seeds = nodes(spark, d).groupBy("user_id").agg(F.min("name").alias("node")).withColumn("query", F.col("user_id"))
    w = Window.partitionBy("query").orderBy(F.desc("confidence"), "id")
    found = graph.traverse(facts(spark, d), seeds, 2).withColumn("place", F.row_number().over(w)).where("place <= 50")
    return found.select("user_id", "id", "src", "predicate", "dst", "place")


@query("op29_conflicts", f"""WITH {N}, {R}, {A}, {G}, new AS (SELECT DISTINCT user_id, src, predicate, dst FROM g)
SELECT g.id, g.dst AS object, count(*) AS others, min(new.dst) AS first_other, max(new.dst) AS last_other
FROM g JOIN new ON g.user_id = new.user_id AND g.src = new.src AND g.predicate = new.predicate AND g.dst <> new.dst GROUP BY ALL""")
def op29(spark, d):
    f = facts(spark, d).select("id", "user_id", F.col("src").alias("subject"), "predicate", F.col("dst").alias("object"))
    return graph.conflicts(f, f).select("id", "object", "others", "first_other", "last_other")


@query("op29_closed", f"""WITH {N}, {R}, {A}, {G}, {_TRIPLES}, k AS (SELECT id, EXISTS (SELECT 1 FROM tr WHERE tr.user_id = g.user_id AND tr.subject = g.src AND tr.predicate = g.predicate AND tr.object <> g.dst) AS closed, confidence AS c FROM g)
SELECT id, closed, round(CASE WHEN closed THEN c * 0.95 ELSE c END, 6) AS confidence FROM k""")
def op29c(spark, d):
    """The facts after those contradicted by new triples are closed."""
    f = facts(spark, d).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    x = graph.close_conflicts(f, _triples(spark, d), ntz(NOW))
    return x.select("id", F.col("valid_to").isNotNull().alias("closed"), F.round("confidence", 6).alias("confidence"))


_BATCH = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, id) AS pos FROM e WHERE user_id IS NOT NULL AND status = 'pending') WHERE pos <= 100)"


@query("op30_neighbours", f"""WITH {E}, {_BATCH}, v AS (SELECT id, user_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM b WHERE len(embedding) = 64
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT l.id, count(*) AS neighbours FROM v l JOIN v r ON l.user_id = r.user_id WHERE 1 - list_cosine_similarity(l.x, r.x) <= 0.3 GROUP BY l.id""")
def op30(spark, d):
    b = con.pending_batch(eps(spark, d, "id", "user_id", "ts", "status", "embedding")).where(vx.usable(F.col("embedding"), DIM))
    n = vx.norm(F.col("embedding"))
    b = b.select("id", "user_id", F.transform("embedding", lambda x: x.cast("double") / n).alias("x"))
    pairs = b.join(b.toDF("other", "user_id", "y"), "user_id")  # at most 100 rows per user
    return pairs.where(1 - vx.dot(F.col("x"), F.col("y")) <= con.EPS + 1e-12).groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"))


# --- aggregates


@query("op35_pending_counts", f"WITH {E} SELECT user_id, count(*) AS pending FROM e WHERE user_id IS NOT NULL AND status = 'pending' GROUP BY user_id")
def op35(spark, d):
    return eps(spark, d, "user_id", "status").where("user_id is not null and status = 'pending'").groupBy("user_id").agg(F.count(F.lit(1)).alias("pending"))


_STATS = f"""WITH {N}, {R}, o AS (SELECT * FROM r WHERE valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}'), c AS (SELECT user_id, count(*) AS nodes FROM n GROUP BY user_id),
x AS (SELECT s.user_id, count(*) AS edges FROM o JOIN n s ON o.src = s.id WHERE o.dst IN (SELECT id FROM n) GROUP BY s.user_id),
s AS (SELECT user_id, {{}} AS nodes, coalesce(edges, 0) AS edges FROM c LEFT JOIN x USING (user_id))
SELECT user_id, nodes, edges, CASE WHEN nodes = 0 THEN 0 ELSE round(edges / nodes, 2) END AS density FROM s"""


def _open(spark, d) -> DataFrame:
    return relations(spark, d).where(graph.valid_at(ntz(AS_OF)))


@query("op36_stats_reference", _STATS.format("CASE WHEN edges IS NULL THEN 0 ELSE nodes END"))
def op36(spark, d):
    return graph.stats(nodes(spark, d), _open(spark, d), "reference")


@query("op37_stats_intended", _STATS.format("nodes"))
def op37(spark, d):
    return graph.stats(nodes(spark, d), _open(spark, d), "intended")


@query("op38_centroids", f"WITH {E}, {V}, u AS (SELECT user_id, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM v) SELECT user_id, pos - 1 AS pos, round(avg(x), 5) AS mean FROM u GROUP BY user_id, pos")
def op38(spark, d):
    c = usable(spark, d).groupBy("user_id").agg(vx.mean("embedding", DIM).alias("m"))
    return c.select("user_id", F.posexplode("m").alias("pos", "mean")).select("user_id", F.col("pos").cast("long").alias("pos"), F.round("mean", 5).alias("mean"))


_SPACE = r"[\s\x{85}\x{1C}-\x{1F}\p{Z}]+"
W = f"""w0 AS (SELECT user_id, ts, turn_id, list_filter(string_split_regex(content, '{_SPACE}'), lambda x: x <> '') AS ws FROM t WHERE user_id IS NOT NULL AND ts IS NOT NULL AND content IS NOT NULL),
w1 AS (SELECT user_id, ts, turn_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w0),
w AS (SELECT *, CASE WHEN regexp_matches(lag(word) OVER (PARTITION BY turn_id, user_id, ts ORDER BY pos), '[.!?]$') THEN 4.0 ELSE 1.0 END
  + CASE WHEN strlen(word) > 8 THEN 1.5 ELSE 0 END + CASE WHEN contains(word, '?') OR contains(word, '!') THEN 2.0 ELSE 0 END AS s FROM w1)"""
ORACLE["op96_token_probabilities"] = ORACLE["op96_token_probabilities"].replace("{W}", W)
ROLL = """k AS (SELECT *, count(*) OVER z AS n, sum((2 * s)::BIGINT) OVER z AS a, sum((4 * s * s)::BIGINT) OVER z AS b FROM w WINDOW z AS (PARTITION BY user_id ORDER BY ts, turn_id, pos ROWS 49 PRECEDING)),
roll AS (SELECT *, n * 2 * s - a AS lead_, n * b - a * a AS spread FROM k),
above AS (SELECT *, lead_ > 0 AND lead_ * lead_ > spread * 6.25 AS above FROM roll)"""


@query("op39_mean_logprob", f"WITH {T}, {W} SELECT t.turn_id, round(coalesce(avg(-s), ln(0.5)), 6) AS mean_logprob FROM t LEFT JOIN w ON t.turn_id = w.turn_id GROUP BY t.turn_id")
def op39(spark, d):
    t = turns(spark, d)
    w = segmentation.words(t).groupBy("turn_id").agg(F.avg(-F.col("s")).alias("m"))
    return t.select("turn_id").distinct().join(w, "turn_id", "left").select("turn_id", F.round(F.coalesce("m", F.log(F.lit(0.5))), 6).alias("mean_logprob"))


@query("op43_distinct_predicates", f"WITH {R}, {A} SELECT DISTINCT user_id, predicate FROM a")
def op43(spark, d):
    return active(spark, d).select("user_id", "predicate").distinct()


# --- segmentation


@query("op45_rolling", f"WITH {T}, {W}, {ROLL} SELECT turn_id, pos, n, round(a / n / 2, 6) AS mean, round(sqrt(spread) / n / 2, 6) AS sigma FROM above")
def op45(spark, d):
    r = segmentation.rolling(turns(spark, d))
    return r.select("turn_id", F.col("pos").cast("long").alias("pos"), "n", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"))


@query("op46_above_threshold", f"WITH {T}, {W}, {ROLL} SELECT turn_id, pos, word, s FROM above WHERE above")
def op46(spark, d):
    return segmentation.rolling(turns(spark, d)).where("above").select("turn_id", F.col("pos").cast("long").alias("pos"), "word", "s")


# The first boundary of a turn and those after it, found one after another.
_SEG = f"""WITH RECURSIVE {T}, {W}, {ROLL}, size AS (SELECT turn_id, user_id, ts, max(pos) AS last FROM above GROUP BY ALL),
able AS (SELECT turn_id, pos FROM above WHERE above AND regexp_matches(word, '[.!?]$')),
seg(turn_id, seg, p, last) AS (SELECT turn_id, 0, 0::BIGINT, last FROM size UNION ALL
  SELECT s.turn_id, s.seg + 1, least(s.p + 500, coalesce((SELECT min(a.pos) FROM able a WHERE a.turn_id = s.turn_id AND a.pos >= s.p + 50 AND a.pos > s.p), s.p + 500)), s.last
  FROM seg s WHERE least(s.p + 500, coalesce((SELECT min(a.pos) FROM able a WHERE a.turn_id = s.turn_id AND a.pos >= s.p + 50 AND a.pos > s.p), s.p + 500)) <= s.last),
ranged AS (SELECT *, coalesce(lead(p) OVER (PARTITION BY turn_id ORDER BY seg), last + 1) AS until FROM seg)
SELECT r.turn_id, r.seg, count(*) AS n_tokens, round(avg(s), 6) AS avg_s, max(s) AS max_s, string_agg(word, ' ' ORDER BY pos) AS content
FROM ranged r JOIN above a ON a.turn_id = r.turn_id AND a.pos >= r.p AND a.pos < r.until GROUP BY r.turn_id, r.seg"""


def _segs(spark, d):
    return segmentation.segments(segmentation.rolling(turns(spark, d)))


@query("op47_segments", _SEG)
def op47(spark, d):
    return _segs(spark, d).select("turn_id", "seg", F.col("n_tokens").cast("long").alias("n_tokens"), F.round("avg_s", 6).alias("avg_s"), "max_s", "content")


@query("op87_episodes", f"""SELECT user_id, x.turn_id, x.seg, x.content, greatest(x.avg_s, x.max_s) AS surprisal, greatest(x.avg_s, x.max_s) AS importance, 'pending' AS status, 1.0::DOUBLE AS decay, x.n_tokens AS token_count
FROM ({_SEG}) x JOIN (SELECT DISTINCT turn_id, nullif(lower(trim(user_id)), '') AS user_id FROM turns) y ON x.turn_id = y.turn_id""")
def op87(spark, d):
    e = segmentation.episodes(_segs(spark, d), keep=["turn_id", "seg"])
    return e.select("user_id", "turn_id", "seg", "content", F.round("surprisal_value", 6).alias("surprisal"), F.round("importance_score", 6).alias("importance"),
                    F.col("consolidation_status").alias("status"), F.col("decay_factor").alias("decay"), F.col("token_count").cast("long").alias("token_count"))


@query("op87_single", f"WITH {T} SELECT turn_id, user_id, 1.0::DOUBLE AS surprisal_value, CASE WHEN content = '' THEN 0 ELSE greatest(1, strlen(content) // 4) END AS token_count FROM t WHERE content IS NOT NULL")
def op87s(spark, d):
    """Whole texts as episodes, where no probabilities are to be had."""
    return segmentation.single_episode(turns(spark, d).where("content is not null")).select("turn_id", "user_id", "surprisal_value", F.col("token_count").cast("long").alias("token_count"))


_LAST = "l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, turn_id DESC) AS back FROM t WHERE user_id IS NOT NULL AND ts IS NOT NULL)"


@query("op48_forced_turns", f"WITH {T}, {_LAST} SELECT user_id, turn_id, back, 1000.0::DOUBLE AS value, greatest(1, strlen(coalesce(content, '')) // 4) AS weight FROM l WHERE back <= 3")
def op48(spark, d):
    t = retrieval.last_turns(turns(spark, d), 3)
    return t.select("user_id", "turn_id", "back", F.lit(1000.0).alias("value"), retrieval.weight(F.coalesce("content", F.lit(""))).alias("weight"))


@query("op49_turn_history", f"WITH {T}, {_LAST} SELECT user_id, turn_id, back FROM l WHERE back <= 100")
def op49(spark, d):
    return retrieval.last_turns(turns(spark, d), 100).select("user_id", "turn_id", "back")


# --- retrieval

_TOP = """top AS (SELECT * FROM (SELECT v.*, round(list_cosine_similarity(v.x, q.vector), 9) AS score, row_number() OVER (PARTITION BY v.user_id ORDER BY round(list_cosine_similarity(v.x, q.vector), 9) DESC, id) AS rank
  FROM v JOIN q USING (user_id)) WHERE rank <= 20)"""


def _top(spark, d, *cols, asked=None):
    """Only ids, users and vectors go through the scoring; the other columns are joined to the few rows found."""
    q = (questions(spark, d) if asked is None else asked).select("query", "user_id", "vector")
    e = table(spark, d, "episodes").where("id is not null").select("id", user_key(F.col("user_id")).alias("user_id"), "embedding")
    e = e.where(F.col("user_id").isNotNull() & vx.usable(F.col("embedding"), DIM))
    found = retrieval.top_k(e, q, 20)
    return found.join(eps(spark, d, "id", *cols), "id") if cols else found


@query("op54_vector_topk", f"WITH {E}, {V}, {Q}, {_TOP} SELECT user_id, id, rank, round(score, 6) AS score FROM top")
def op54(spark, d):
    return _top(spark, d).select("user_id", "id", "rank", F.round("score", 6).alias("score"))


@query("op55_recent", f"WITH {E} SELECT id, place FROM (SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id) AS place FROM e WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE place <= 50")
def op55(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "id")
    return eps(spark, d, "id", "user_id", "ts").where("user_id is not null and ts is not null").withColumn("place", F.row_number().over(w)).where("place <= 50").select("id", "place")


@query("op56_pending_batch", f"WITH {E}, {_BATCH} SELECT user_id, id, pos FROM b")
def op56(spark, d):
    return con.pending_batch(eps(spark, d, "id", "user_id", "ts", "status")).select("user_id", "id", "pos")


_NAMES = """list_concat(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]') AND strlen(x) >= 2),
  list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN regexp_matches(w[i], '^[A-Z]') AND regexp_matches(w[i + 1], '^[A-Z]') THEN w[i] || ' ' || w[i + 1] END), lambda x: x IS NOT NULL))"""
_TRIMMED = "list_transform(list_filter(string_split_regex(text, '" + _SPACE + "'), lambda x: x <> ''), lambda x: trim(x, '.,!?;:''\"()[]'))"
_GRAPH = f"""qn AS (SELECT q.user_id, q.text || coalesce(' What about ' || min(n.name) || '?', '') AS text FROM q LEFT JOIN n ON q.user_id = n.user_id GROUP BY q.user_id, q.text),
qw AS (SELECT user_id, {_TRIMMED} AS w FROM qn), seeds AS (SELECT DISTINCT user_id, unnest({_NAMES}) AS node FROM qw), {_HOPS},
found AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, id) AS place FROM hops)"""
_MERGE = """m AS (SELECT user_id, id, 'ep:' || id AS key, 'vector' AS source, rank, score, coalesce(content, '') AS content, ts, surprisal, importance, decay, NULL::DOUBLE AS confidence FROM top
  UNION ALL SELECT user_id, id, {}, 'graph', place, confidence, src || ' ' || predicate || ' ' || dst || '. ', NULL, NULL, NULL, NULL, confidence FROM found WHERE place <= 50),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY source DESC, rank) AS rn FROM m) WHERE rn = 1)"""


def _fused(spark, d, mode):
    """Episodes near each question and facts near the names in it, to which that of the user's first entity is added; a question
    without names has no facts."""
    q = shared_checkpoint(questions(spark, d))
    v = _top(spark, d, "content", "ts", "surprisal", "importance", "decay", asked=q).withColumn("content", F.coalesce("content", F.lit("")))
    known = nodes(spark, d).groupBy("user_id").agg(F.min("name").alias("name"))
    said = F.concat("text", F.coalesce(F.concat(F.lit(" What about "), "name", F.lit("?")), F.lit("")))
    seeds = q.join(known, "user_id", "left").select("query", "user_id", F.explode(tx.entity_names(said)).alias("node")).distinct()
    w = Window.partitionBy("query").orderBy(F.desc("confidence"), "id")
    g = graph.traverse(shared_checkpoint(facts(spark, d)), seeds, 2).withColumn("rank", F.row_number().over(w)).where("rank <= 50")
    g = g.select("query", "user_id", "id", "rank", F.col("confidence").alias("score"), graph.fact_sentence("src", "predicate", "dst").alias("content"), "confidence", F.col("src").alias("subject"), "predicate", F.col("dst").alias("object"))
    return retrieval.merge_results(v, g, mode)


_HEAD = f"WITH {E}, {V}, {Q}, {N}, {R}, {A}, {G}, {_TOP}, {_GRAPH}"
_REF = _MERGE.format("'ep:'")
_INT = _MERGE.format("'gf:' || src || ':' || predicate || ':' || dst || '|'")


@query("op60_merge_reference", f"{_HEAD}, {_REF} SELECT user_id, key, source, rank, round(score, 6) AS score FROM merged")
def op60(spark, d):
    return _fused(spark, d, "reference").select("user_id", "key", "source", "rank", F.round("score", 6).alias("score"))


@query("op60_merge_intended", f"{_HEAD}, {_INT} SELECT user_id, key, source, rank, round(score, 6) AS score FROM merged")
def op60i(spark, d):
    return _fused(spark, d, "intended").select("user_id", "key", "source", "rank", F.round("score", 6).alias("score"))


@query("op61_vector_branch_only", f"WITH {E}, {V}, {Q}, {_TOP} SELECT user_id, 'ep:' || id AS key, 'vector' AS source FROM top")
def op61(spark, d):
    """The graph branch gave nothing: the union is the other branch."""
    none = spark.createDataFrame([], "query string, user_id string, id string, rank int, score double, content string, confidence double, subject string, predicate string, object string")
    v = _top(spark, d, "content", "ts", "surprisal", "importance", "decay")
    return retrieval.merge_results(v, none).select("user_id", "key", "source")


def _scored(spark, d, fallback: bool) -> DataFrame:
    """Gain by a provider that fails where a result's content has an odd number of octets."""
    from recollect import providers

    m = _fused(spark, d, "reference").join(questions(spark, d).select("user_id", "text"), "user_id")
    score = F.when(F.octet_length("content") % 2 == 0, providers.gain(providers.Offline(DIM), F.col("text"), F.col("content")))
    return retrieval.rerank(m.withColumn("_score", score), F.lit(NOW_S), score=F.col("_score"), fallback=fallback)


_GAIN = f"""gain AS (SELECT *, CASE WHEN source = 'graph' THEN 0.15 * confidence ELSE (score + 0.3 * exp(-(({NOW_S} - epoch_us(ts) // 1000000) / 3600.0) / 24)
  + CASE WHEN coalesce(surprisal, 0) > 0 THEN 0.2 * ln(1 + surprisal) / 5 ELSE 0 END + 0.1 * coalesce(importance, 0)) * coalesce(decay, 0) END AS gain FROM merged WHERE content <> ''),
ranked AS (SELECT * FROM gain WHERE gain > -0.5)"""


def _ranked(spark, d):
    """The ranked results of all questions: small, and used several times by what packs them."""
    return shared_checkpoint(retrieval.rerank(_fused(spark, d, "reference"), F.lit(NOW_S)))


# Overlap of words, as the offline provider scores it, with the heuristic or nothing where that fails.
_DIG = r"""qs AS (SELECT user_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x <> '')) AS qw FROM q),
dig AS (SELECT g.user_id, key, gain AS heuristic, CASE WHEN strlen(content) % 2 = 0 THEN
  len(list_intersect(qw, list_distinct(list_filter(string_split_regex(lower(content), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x <> '')))) / greatest(len(qw), 1) END AS score FROM gain g JOIN qs USING (user_id))"""


@query("op69_provider_gain", f"{_HEAD}, {_REF}, {_GAIN}, {_DIG} SELECT user_id, key, round(coalesce(score, heuristic), 5) AS gain FROM dig WHERE coalesce(score, heuristic) > -0.5")
def op69(spark, d):
    return _scored(spark, d, True).select("user_id", "key", F.round("gain", 5).alias("gain"))


@query("op69_provider_only", f"{_HEAD}, {_REF}, {_GAIN}, {_DIG} SELECT user_id, key, round(score, 5) AS gain FROM dig WHERE score > -0.5")
def op69o(spark, d):
    return _scored(spark, d, False).select("user_id", "key", F.round("gain", 5).alias("gain"))


@query("op71_rerank", f"{_HEAD}, {_REF}, {_GAIN} SELECT user_id, key, round(gain, 5) AS gain FROM ranked")
def op71(spark, d):
    return _ranked(spark, d).select("user_id", "key", F.round("gain", 5).alias("gain"))


_PACK = f"""forced AS (SELECT user_id, sum(greatest(1, strlen(coalesce(content, '')) // 4)) AS forced FROM l WHERE back <= 3 GROUP BY user_id),
c AS (SELECT ranked.user_id, key, content, gain, greatest(1, strlen(content) // 4) AS weight, {BUDGET} - coalesce(forced, 0) AS room FROM ranked LEFT JOIN forced USING (user_id)),
dens AS (SELECT *, gain / weight AS density, sum(CASE WHEN gain > 0 THEN weight ELSE 0 END) OVER (PARTITION BY user_id ORDER BY gain / weight DESC, key ROWS UNBOUNDED PRECEDING) AS cum FROM c WHERE room > 0),
brk AS (SELECT *, coalesce(max(CASE WHEN density > 0 AND cum > room THEN density END) OVER (PARTITION BY user_id), 0) AS least FROM dens),
chosen AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY density DESC, key) AS place FROM brk WHERE density >= least AND cum <= room)"""


def _packed(spark, d):
    c = _ranked(spark, d).select("user_id", F.col("key").alias("id"), "content", F.col("gain").alias("value"), retrieval.weight(F.col("content")).alias("weight"))
    f = retrieval.last_turns(turns(spark, d), 3).groupBy("user_id").agg(F.sum(retrieval.weight(F.coalesce("content", F.lit("")))).alias("forced"))
    b = c.select("user_id").distinct().join(f, "user_id", "left").select("user_id", F.lit(BUDGET).alias("budget"), F.coalesce("forced", F.lit(0)).alias("forced"))
    return c, retrieval.knapsack(c.drop("content"), b, ["user_id"]), b


@query("op51_knapsack", f"{_HEAD}, {_REF}, {_GAIN}, {T}, {_LAST}, {_PACK} SELECT user_id, key AS id, place, weight FROM chosen")
def op51(spark, d):
    return _packed(spark, d)[1].select("user_id", "id", F.col("place").cast("long").alias("place"), "weight")


@query("op42_utilization", f"""{_HEAD}, {_REF}, {_GAIN}, {T}, {_LAST}, {_PACK}, used AS (SELECT user_id, sum(weight) AS w FROM chosen GROUP BY user_id)
SELECT u.user_id, coalesce(f.forced, 0) + coalesce(w, 0) AS total_tokens, round((coalesce(f.forced, 0) + coalesce(w, 0)) / {BUDGET}, 6) AS utilization, round(least(100, (coalesce(f.forced, 0) + coalesce(w, 0)) * 100 / {BUDGET}), 4) AS percent
FROM (SELECT DISTINCT user_id FROM ranked) u LEFT JOIN forced f USING (user_id) LEFT JOIN used USING (user_id)""")
def op42(spark, d):
    _, chosen, b = _packed(spark, d)
    used = b.join(chosen.groupBy("user_id").agg(F.sum("weight").alias("w")), "user_id", "left")
    n = (F.col("forced") + F.coalesce("w", F.lit(0))).cast("long")
    return used.select("user_id", n.alias("total_tokens"), F.round(n / BUDGET, 6).alias("utilization"), F.round(F.least(F.lit(100.0), n * 100 / BUDGET), 4).alias("percent"))


@query("op73_query_context", f"""{_HEAD}, {_REF}, {_GAIN}, {T}, {_LAST}, {_PACK},
tt AS (SELECT user_id, string_agg(coalesce(content, '') || chr(10), '' ORDER BY back DESC) AS s FROM l WHERE back <= 3 GROUP BY user_id),
mm AS (SELECT user_id, string_agg('[Memory ' || place || '] ' || content || chr(10), '' ORDER BY place) AS s FROM chosen GROUP BY user_id)
SELECT q.user_id, coalesce('## Recent Conversation' || chr(10) || tt.s || chr(10), '') || coalesce('## Retrieved Memories' || chr(10) || mm.s || chr(10), '') || '## Current Query' || chr(10) || q.text AS context
FROM q LEFT JOIN tt USING (user_id) LEFT JOIN mm USING (user_id)""")
def op73(spark, d):
    c, chosen, _ = _packed(spark, d)
    lists = lambda df, by, alias: df.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(by.alias("o"), F.coalesce("content", F.lit("")).alias("c")))).alias("x")).select("user_id", F.transform("x", lambda y: y["c"]).alias(alias))
    m = lists(chosen.join(c.select("user_id", "id", "content"), ["user_id", "id"]), F.col("place"), "memories")
    t = lists(retrieval.last_turns(turns(spark, d), 3), -F.col("back"), "turns")
    q = questions(spark, d).join(t, "user_id", "left").join(m, "user_id", "left")
    none = F.array().cast("array<string>")
    return q.select("user_id", retrieval.context_text(F.coalesce("turns", none), F.coalesce("memories", none), F.col("text")).alias("context"))


# --- consolidation


_DBSCAN = f"""WITH RECURSIVE {E}, {_BATCH}, v AS (SELECT id, user_id, pos, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM b WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT l.user_id, l.pos AS p, r.pos AS o FROM v l JOIN v r ON l.user_id = r.user_id WHERE 1 - list_cosine_similarity(l.x, r.x) <= 0.3 + 1e-12),
core AS (SELECT user_id, p FROM near GROUP BY user_id, p HAVING count(*) >= 3),
link AS (SELECT n.user_id, n.p, n.o FROM near n SEMI JOIN core a ON n.user_id = a.user_id AND n.p = a.p SEMI JOIN core c ON n.user_id = c.user_id AND n.o = c.p),
reach AS (SELECT user_id, p, p AS o FROM core UNION SELECT r.user_id, r.p, l.o FROM reach r JOIN link l ON r.user_id = l.user_id AND r.o = l.p),
root AS (SELECT user_id, p, min(o) AS root FROM reach GROUP BY user_id, p),
number AS (SELECT user_id, p, dense_rank() OVER (PARTITION BY user_id ORDER BY root) AS cluster FROM root),
border AS (SELECT n.user_id, n.p, min(c.cluster) AS cluster FROM near n JOIN number c ON n.user_id = c.user_id AND n.o = c.p ANTI JOIN core ON n.user_id = core.user_id AND n.p = core.p GROUP BY n.user_id, n.p),
label AS (SELECT b.user_id, b.id, b.pos, coalesce(number.cluster, border.cluster, -b.pos)::INT AS cluster FROM b LEFT JOIN number ON b.user_id = number.user_id AND b.pos = number.p
  LEFT JOIN border ON b.user_id = border.user_id AND b.pos = border.p)"""


@query("op63_dbscan", f"{_DBSCAN} SELECT user_id, id, cluster FROM label")
def op63(spark, d):
    return con.dbscan(con.pending_batch(eps(spark, d, "id", "user_id", "ts", "status", "embedding")), DIM)


@query("op41_clusters", f"{_DBSCAN} SELECT user_id, cluster, string_agg(id, ',' ORDER BY pos) AS ids FROM label GROUP BY user_id, cluster")
def op41(spark, d):
    b = con.pending_batch(eps(spark, d, "id", "user_id", "ts", "status", "embedding"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    return con.dbscan(b, DIM).join(b.select("id", "pos"), "id").groupBy("user_id", "cluster").agg(F.array_join(ids, ",").alias("ids"))


@query("op64_gist_prompts", f"""WITH {E}, {_BATCH}, p AS (SELECT * FROM b WHERE ts IS NOT NULL AND content <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i FROM p)
SELECT user_id, string_agg('Episode ' || i || ' (t=' || strftime(ts, '%Y-%m-%dT%H:%M') || '): ' || content || chr(10), '' ORDER BY i) AS prompt FROM o GROUP BY user_id""")
def op64(spark, d):
    b = con.pending_batch(eps(spark, d, "id", "user_id", "ts", "status", "content")).where("ts is not null and content <> ''")
    rows = F.array_sort(F.collect_list(F.struct("pos", "ts", "content")))
    return b.groupBy("user_id").agg(rows.alias("r")).select("user_id", con.gist_prompt(F.col("r")).alias("prompt"))


@query("op65_parse_facts", f"WITH {N}, {R}, {A}, {G} SELECT id, src AS subject, predicate, dst AS object, round(confidence, 6) AS confidence FROM g")
def op65(spark, d):
    one = F.array(F.struct(F.col("src").alias("subject"), "predicate", F.col("dst").alias("object"), "confidence"))
    reply = F.concat(F.lit("```json\n"), F.to_json(one), F.lit("\n```"))
    x = facts(spark, d).select("id", F.explode(con.parse_facts(reply)).alias("f"))
    return x.select("id", "f.subject", "f.predicate", "f.object", F.round("f.confidence", 6).alias("confidence"))


@query("op66_merge_entities", f"""WITH {N}, {R}, mm AS (SELECT user_id, src AS e, transaction_time AS seen FROM r UNION ALL SELECT user_id, dst, transaction_time FROM r),
x AS (SELECT n.name, mm.user_id, mm.seen FROM mm JOIN n ON mm.e = n.id AND mm.user_id = n.user_id)
SELECT name, user_id, strftime(min(seen), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(max(seen), '%Y-%m-%d %H:%M:%S') AS last_accessed FROM x GROUP BY name, user_id""")
def op66(spark, d):
    r = relations(spark, d)
    ends = r.select("user_id", F.col("src").alias("id"), F.col("transaction_time").alias("at")).unionByName(r.select("user_id", F.col("dst").alias("id"), F.col("transaction_time").alias("at")))
    x = graph.merge_entities(ends.join(nodes(spark, d).select("id", "user_id", "name"), ["id", "user_id"]).select("name", "user_id", "at"))
    return x.select("name", "user_id", F.date_format("created_at", SECOND).alias("created_at"), F.date_format("last_accessed", SECOND).alias("last_accessed"))


@query("op67_resolve_conflicts", f"""WITH {R}, f AS (SELECT * FROM r WHERE user_id IS NOT NULL AND src IS NOT NULL AND predicate IS NOT NULL AND valid_from IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, src, predicate ORDER BY valid_from, id) AS i FROM f),
k AS (SELECT *, CASE WHEN lag(dst) OVER z IS DISTINCT FROM dst OR i = 1 THEN 1 ELSE 0 END AS c FROM o WINDOW z AS (PARTITION BY user_id, src, predicate ORDER BY i)),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id, src, predicate ORDER BY i) AS run FROM k),
s AS (SELECT user_id, src, predicate, run - 1 AS run, min(valid_from) AS closed FROM g GROUP BY ALL)
SELECT g.id, strftime(closed, '%Y-%m-%d %H:%M:%S') AS closed_at, round(CASE WHEN closed IS NULL THEN confidence ELSE confidence * 0.95 END, 6) AS confidence
FROM g LEFT JOIN s ON g.user_id = s.user_id AND g.src = s.src AND g.predicate = s.predicate AND g.run = s.run""")
def op67(spark, d):
    x = graph.resolve_conflicts(relations(spark, d), ["user_id", "src", "predicate"], "dst", "valid_from", "id")
    return x.select("id", F.date_format(from_micros("closed_us"), SECOND).alias("closed_at"), F.round("new_confidence", 6).alias("confidence"))


def _run(spark, d):
    """One run: (clustered batch, gists with facts). The provider fails for clusters of one episode without content."""
    from recollect import providers

    p = providers.Offline(DIM)
    b = con.pending_batch(eps(spark, d, "id", "user_id", "ts", "status", "content", "embedding"))
    c = con.dbscan(b, DIM).join(b.select("id", "pos", "ts", "content"), "id")
    rows = F.array_sort(F.collect_list(F.struct("pos", "id", "ts", F.coalesce("content", F.lit("")).alias("content"))))
    g = c.groupBy("user_id", "cluster").agg(rows.alias("r"))
    said = F.exists("r", lambda x: x["content"] != "")
    g = g.withColumn("gist", F.when(said, providers.synthesize(p, con.gist_prompt(F.col("r")))))
    return c, g.withColumn("facts", con.parse_facts(providers.extract_facts(p, F.col("gist")))).withColumn("source_ep_id", F.get("r", F.lit(0))["id"])


@query("op68_consolidate")
def op68(spark, d):
    """Gists and the number of facts of each cluster of one run."""
    _, g = _run(spark, d)
    return g.select("user_id", "cluster", "source_ep_id", F.size("r").alias("episodes"), F.size("facts").alias("facts"), "gist")


@query("op68_episodes", f"""{_DBSCAN}, said AS (SELECT l.user_id, l.cluster FROM label l JOIN e USING (id) WHERE e.content <> '' GROUP BY l.user_id, l.cluster),
done AS (SELECT l.id FROM label l SEMI JOIN said ON l.user_id = said.user_id AND l.cluster = said.cluster)
SELECT e.id, CASE WHEN done.id IS NOT NULL THEN 'consolidated' ELSE status END AS status, CASE WHEN done.id IS NOT NULL THEN 0.95 ELSE decay END::DOUBLE AS decay FROM e LEFT JOIN done ON e.id = done.id""")
def op68e(spark, d):
    """The episodes after the run: consolidated and decayed, but those of clusters for which the provider failed stay pending."""
    batch, g = _run(spark, d)
    return con.consolidated(eps(spark, d, "id", "status", "decay"), batch, g)


@query("op68_graph")
def op68g(spark, d):
    """The graph after the run: contradicted facts closed, those of the gists written."""
    _, g = _run(spark, d)
    t = g.select("user_id", "source_ep_id", F.explode("facts").alias("f")).select("user_id", "f.*", "source_ep_id")
    e = facts(spark, d).withColumn("valid_to", F.lit(None).cast("timestamp_ntz")).withColumn("source_ep_id", F.lit(""))
    n, e = graph.insert_triples(nodes(spark, d), graph.close_conflicts(e, t, ntz(NOW)), t, ntz(NOW))
    counts = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("valid_to").isNotNull()).alias("closed"))
    return n.groupBy("user_id").agg(F.count(F.lit(1)).alias("nodes")).join(counts, "user_id", "left")


# --- scalar functions


@query("op74_cosine", f"WITH {E}, {V}, {Q} SELECT v.id, round(1 - list_cosine_similarity(v.x, q.vector), 6) AS distance, round(list_cosine_similarity(v.x, q.vector), 6) AS similarity FROM v JOIN q USING (user_id)")
def op74(spark, d):
    x = usable(spark, d).join(questions(spark, d).select("user_id", "vector"), "user_id")
    a, b = F.col("embedding"), F.col("vector")
    return x.select("id", F.round(vx.cosine_distance(a, b), 6).alias("distance"), F.round(vx.cosine_similarity(a, b), 6).alias("similarity"))


@query("op76_count_tokens", f"WITH {E} SELECT id, CASE WHEN content = '' THEN 0 ELSE greatest(1, strlen(content) // 4) END AS tokens, greatest(1, strlen(content) // 4) AS weight FROM e WHERE content IS NOT NULL")
def op76(spark, d):
    return eps(spark, d, "id", "content").where("content is not null").select("id", tx.count_tokens(F.col("content")).cast("long").alias("tokens"), tx.count_tokens(F.col("content"), 1).cast("long").alias("weight"))


@query("op77_surprisal", f"WITH {T}, {W} SELECT turn_id, pos, word, s, greatest(0, s) AS surprisal FROM w")
def op77(spark, d):
    return segmentation.words(turns(spark, d)).select("turn_id", F.col("pos").cast("long").alias("pos"), "word", "s", F.greatest(F.lit(0.0), "s").alias("surprisal"))


@query("op79_squeeze", f"WITH {T} SELECT turn_id, array_to_string(list_filter(string_split_regex(content, '{_SPACE}'), lambda x: x <> ''), ' ') AS words FROM t WHERE content IS NOT NULL")
def op79(spark, d):
    return turns(spark, d).where("content is not null").select("turn_id", tx.squeeze(F.col("content")).alias("words"))


@query("op80_entity_names", f"""WITH {T}, x AS (SELECT turn_id, list_transform(list_filter(string_split_regex(content, '{_SPACE}'), lambda x: x <> ''), lambda x: trim(x, '.,!?;:''"()[]')) AS w FROM t WHERE content IS NOT NULL)
SELECT turn_id, array_to_string(list_concat(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]') AND strlen(x) >= 2),
  list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN regexp_matches(w[i], '^[A-Z]') AND regexp_matches(w[i + 1], '^[A-Z]') THEN w[i] || ' ' || w[i + 1] END), lambda x: x IS NOT NULL)), '|') AS names FROM x""")
def op80(spark, d):
    return turns(spark, d).where("content is not null").select("turn_id", F.array_join(tx.entity_names(F.col("content")), "|").alias("names"))


@query("op81_tokenize", rf"WITH {T} SELECT turn_id, len(list_filter(string_split_regex(content, '[\s\p{{P}}]+'), lambda x: x <> '')) AS n FROM t WHERE content IS NOT NULL")
def op81(spark, d):
    return turns(spark, d).where("content is not null").select("turn_id", F.size(tx.tokenize(F.col("content"))).cast("long").alias("n"))


@query("op81_truncate", f"""WITH {T}, h AS (SELECT turn_id, content, left(content, list_max(list_filter(range(0, 61), lambda k: strlen(left(content, k)) <= 60))) AS h FROM t WHERE content IS NOT NULL),
c AS (SELECT *, regexp_extract(h, '^(.*) ', 1, 's') AS c FROM h)
SELECT turn_id, CASE WHEN strlen(content) <= 60 THEN content WHEN strlen(c) > 30 THEN c || '...' ELSE h || '...' END AS short FROM c""")
def op81t(spark, d):
    return turns(spark, d).where("content is not null").select("turn_id", tx.truncate(F.col("content"), 60).alias("short"))


@query("op82_log_tail", """SELECT event_id, module, event_type AS msg, row_number() OVER (ORDER BY ts, event_id) AS place FROM
(SELECT *, CASE WHEN event_id % 3 = 0 THEN 'system' ELSE 'api' END AS module FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)""")
def op82(spark, d):
    module = F.when(F.col("event_id") % 3 != 0, F.lit("api"))
    lines = table(spark, d, "events").select("event_id", F.to_json(F.struct("ts", module.alias("module"), F.concat_ws("|", "event_id", "event_type").alias("msg"))).alias("value"))
    logs = requests.log_entries(lines).withColumn("event_id", F.split("msg", "[|]")[0].cast("long")).withColumn("msg", F.split("msg", "[|]")[1])
    return requests.log_tail(logs, "ts", "event_id").select("event_id", "module", "msg", "place")


@query("op84_dates", f"WITH {T} SELECT turn_id, epoch_us(ts) // 1000000 AS unix_s, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, strftime(ts, '%H%M%S') AS turn_key FROM t WHERE ts IS NOT NULL")
def op84(spark, d):
    return turns(spark, d).where("ts is not null").select("turn_id", F.floor(micros("ts") / 1_000_000).alias("unix_s"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("rfc3339"), F.date_format("ts", "HHmmss").alias("turn_key"))


@query("op85_score_map", f"WITH {E} SELECT user_id, count(*) AS n, round(sum(surprisal), 4) AS total FROM e WHERE user_id IS NOT NULL AND surprisal IS NOT NULL GROUP BY user_id")
def op85(spark, d):
    e = eps(spark, d, "id", "user_id", "surprisal").where("user_id is not null and surprisal is not null")
    m = e.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("user_id", "_b").agg(F.map_from_entries(F.collect_list(F.struct("id", "surprisal"))).alias("scores"))
    parts = m.select("user_id", F.size(F.map_keys("scores")).alias("n"), F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    return parts.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 4).alias("total"))


# --- activity and metrics

_ACT = """act AS (SELECT user_id, max(ts) AS last FROM (SELECT user_id, ts FROM t UNION ALL SELECT user_id, ts FROM e) WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id)"""


def _activity(spark, d):
    x = turns(spark, d).select("user_id", "ts").unionByName(eps(spark, d, "user_id", "ts"))
    return x.where("user_id is not null and ts is not null").groupBy("user_id").agg(F.max("ts").alias("last"))


@query("op88_last_activity", f"WITH {E}, {T}, {_ACT} SELECT user_id, strftime(last, '%Y-%m-%d %H:%M:%S') AS last FROM act")
def op88(spark, d):
    return _activity(spark, d).select("user_id", F.date_format("last", SECOND).alias("last"))


_SEEN = _ACT.replace("ts IS NOT NULL", f"ts <= TIMESTAMP '{TICK}'").replace("act AS", "seen AS")
_DUE = f"""{_SEEN}, p AS (SELECT user_id, count(*) AS pending FROM e WHERE status = 'pending' GROUP BY user_id),
ticks AS (SELECT TIMESTAMP '{TICK}' + m * INTERVAL 1 MINUTE AS tick, m FROM (VALUES (0), (1), (5), (6)) v(m)),
due AS (SELECT user_id, tick, m, CASE WHEN tick - last > INTERVAL 15 MINUTE THEN 'inactivity_timeout' ELSE 'max_unconsolidated' END AS reason FROM ticks, seen LEFT JOIN p USING (user_id)
  WHERE tick - last > INTERVAL 15 MINUTE OR coalesce(pending, 0) >= 10)"""


def _seen(spark, d):
    x = turns(spark, d).select("user_id", "ts").unionByName(eps(spark, d, "user_id", "ts"))
    return x.where("user_id is not null").where(F.col("ts") <= ntz(TICK)).groupBy("user_id").agg(F.max("ts").alias("last"))


@query("op89_due", f"WITH {E}, {T}, {_DUE} SELECT user_id, reason FROM due WHERE m = 0")
def op89(spark, d):
    return con.due(_seen(spark, d), op35(spark, d), ntz(TICK)).select("user_id", "reason")


@query("op90_ticks", f"""WITH RECURSIVE {E}, {T}, {_DUE}, jobs AS (SELECT user_id, min(m) AS m FROM due GROUP BY user_id UNION ALL
  SELECT j.user_id, (SELECT min(d.m) FROM due d WHERE d.user_id = j.user_id AND d.m >= j.m + 5) FROM jobs j WHERE (SELECT min(d.m) FROM due d WHERE d.user_id = j.user_id AND d.m >= j.m + 5) IS NOT NULL)
SELECT user_id, reason, strftime(tick, '%Y-%m-%d %H:%M:%S') AS sent_at FROM jobs JOIN due USING (user_id, m)""")
def op90(spark, d):
    """The scheduler over four ticks: a job holds its user for five minutes."""
    active_, pending = shared_checkpoint(_seen(spark, d)), shared_checkpoint(op35(spark, d))
    holds, out = spark.createDataFrame([], "user_id string, until timestamp_ntz"), None
    for m in (0, 1, 5, 6):
        jobs, holds = con.tick(active_, pending, holds, ntz(TICK) + F.expr(f"interval {m} minutes"))
        out = jobs if out is None else out.unionByName(jobs)
    return out.select("user_id", "reason", F.date_format("at", SECOND).alias("sent_at"))


@query("op92_session_windows", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n_events FROM s GROUP BY user_id, n""")
def op92(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    # the native window joins a gap of exactly 15 minutes
    s = e.groupBy("user_id", F.session_window("ts", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select("user_id", F.date_format("w.start", SECOND).alias("session_start"), "n_events")


@query("op95_histogram", f"WITH {E}, les AS (SELECT unnest([-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0]::DOUBLE[]) AS le UNION ALL SELECT 'inf'::DOUBLE) SELECT le, count(*) FILTER (surprisal <= le) AS n FROM les, e WHERE surprisal IS NOT NULL GROUP BY le")
def op95(spark, d):
    return requests.histogram(eps(spark, d, "surprisal"), "surprisal", [-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0])


@query("op95_counters", f"WITH {E}, {R}, {A} SELECT (SELECT count(*) FROM e) AS episodes, (SELECT count(*) FROM e WHERE status = 'consolidated') AS consolidated, (SELECT count(*) FROM a) AS active_edges")
def op95c(spark, d):
    e = eps(spark, d, "status").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("status") == "consolidated").alias("consolidated"), F.lit(0).cast("long").alias("active_edges"))
    a = active(spark, d).agg(F.lit(0).cast("long").alias("episodes"), F.lit(0).cast("long").alias("consolidated"), F.count(F.lit(1)).alias("active_edges"))
    return e.unionByName(a).agg(*[F.sum(c).alias(c) for c in ("episodes", "consolidated", "active_edges")])


def _buckets(name: str, value: str, source: str, label: str = "''") -> str:
    """SQL of a histogram's lines."""
    le = lambda b: f"concat_ws(',', nullif(lab, ''), 'le=\"{b}\"')"
    x = f"(SELECT {label} AS lab, ({value})::DOUBLE AS v FROM {source} WHERE ({value}) IS NOT NULL)"
    parts = [f"SELECT '{name}_bucket' AS metric, {le(f'{b:g}')} AS labels, count(*) FILTER (v <= {b})::DOUBLE AS value FROM {x} GROUP BY lab" for b in metrics.HISTOGRAMS[name]]
    parts += [f"SELECT '{name}_bucket', {le('+Inf')}, count(*)::DOUBLE FROM {x} GROUP BY lab", f"SELECT '{name}_sum', lab, sum(v) FROM {x} GROUP BY lab", f"SELECT '{name}_count', lab, count(*)::DOUBLE FROM {x} GROUP BY lab"]
    return " UNION ALL ".join(parts)


_METRICS = " UNION ALL ".join([
    "SELECT 'ingest_episodes_total' AS metric, '' AS labels, count(*)::DOUBLE AS value FROM e",
    "SELECT 'retrieval_vector_searches_total', '', count(*)::DOUBLE FROM q",
    "SELECT 'retrieval_graph_searches_total', '', count(DISTINCT user_id)::DOUBLE FROM seeds",
    "SELECT 'dig_filtered_total', '', count(*)::DOUBLE FROM gain WHERE gain <= -0.5",
    "SELECT 'consolidation_episodes_consolidated_total', '', count(*)::DOUBLE FROM e WHERE status = 'consolidated'",
    "SELECT 'http_requests_total', 'event_type=\"' || event_type || '\"', count(*)::DOUBLE FROM events GROUP BY event_type",
    _buckets("dig_score_distribution", "gain", "gain"),
    _buckets("knapsack_items_selected", "n", "(SELECT user_id, count(*) AS n FROM chosen GROUP BY user_id)"),
    _buckets("http_request_duration_seconds", "value / 1000", "events", "'event_type=\"' || event_type || '\"'"),
])


@query("op95_instruments", f"{_HEAD}, {_REF}, {_GAIN}, {T}, {_LAST}, {_PACK} SELECT metric, labels, round(value, 4) AS value FROM ({_METRICS})")
def op95i(spark, d):
    """Instruments over the tables: those of ingestion, retrieval, gain, packing, consolidation and requests."""
    e, ev = eps(spark, d, "id", "status"), table(spark, d, "events").withColumn("s", F.col("value") / 1000)
    fused = shared_checkpoint(_fused(spark, d, "reference"))
    q = fused.where("source = 'vector'").select("query").distinct()
    gain = retrieval.rerank(fused, F.lit(NOW_S), least=-1e9)
    said = F.concat("text", F.coalesce(F.concat(F.lit(" What about "), "name", F.lit("?")), F.lit("")))
    asked = questions(spark, d).join(nodes(spark, d).groupBy("user_id").agg(F.min("name").alias("name")), "user_id", "left").where(F.size(tx.entity_names(said)) > 0)
    items = _packed(spark, d)[1].groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    lines = [
        metrics.counter(e, "ingest_episodes_total"), metrics.counter(q, "retrieval_vector_searches_total"), metrics.counter(asked, "retrieval_graph_searches_total"),
        metrics.counter(gain.where("gain <= -0.5"), "dig_filtered_total"), metrics.counter(e.where("status = 'consolidated'"), "consolidation_episodes_consolidated_total"),
        metrics.counter(ev, "http_requests_total", ["event_type"]), metrics.histogram(gain, "dig_score_distribution", "gain"),
        metrics.histogram(items, "knapsack_items_selected", "n"), metrics.histogram(ev, "http_request_duration_seconds", "s", ["event_type"]),
    ]
    out = lines[0]
    for x in lines[1:]:
        out = out.unionByName(x)
    return out.select("metric", "labels", F.round("value", 4).alias("value"))
