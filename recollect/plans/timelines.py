"""Queries on time: histories (p2), covered periods (p3) and sessions (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.history import amended, bitemporal_ledger, versions
from recollect.operators.intervals import covered
from recollect.operators.sessions import gap_tree, sessions
from recollect.sources.tables import from_micros, micros, table, type_key, user_key

SESSION_GAP_US = 15 * 60 * 1_000_000
SECOND = "yyyy-MM-dd HH:mm:ss"
MICRO = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _statements(spark: SparkSession, d: str, single: bool) -> DataFrame:
    """Statements of the single-valued types or of the others, with the type spelled as in relation_types; a valid_to in
    the year 2100 or later is open."""
    types = table(spark, d, "relation_types").where(F.col("single_valued") == single)
    types = types.select(type_key(F.col("relation_type")).alias("_type"), F.col("relation_type").alias("_name"))
    rows = table(spark, d, "relationships").select("from_entity_id", "to_entity_id", "relation_type", "valid_from", "valid_to", "transaction_time")
    # the list of types is fixed and short; Spark's size estimate of the file decides on the broadcast
    rows = rows.withColumn("_type", type_key(F.col("relation_type"))).join(types, "_type").drop("_type", "relation_type")
    return rows.withColumnRenamed("_name", "relation_type").withColumn("valid_to", F.when(F.year("valid_to") < 2100, F.col("valid_to")))


def _shown(name: str, form: str = SECOND):
    return F.date_format(from_micros(name), form)


def attribute_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The whole bitemporal ledger of the single-valued types."""
    return bitemporal_ledger(_statements(spark, d, True), ["from_entity_id", "relation_type"], "to_entity_id", "valid_from", micros("valid_to"), "transaction_time")


def p2_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _ledger_rows(attribute_ledger(spark, d))


def p2_amended(spark: SparkSession, d: str) -> DataFrame:
    """The ledger as first built from what was recorded before May 2015, then amended by the later statements."""
    rows, keys = _statements(spark, d, True), ["from_entity_id", "relation_type"]
    late = F.coalesce(F.col("transaction_time") >= F.expr("timestamp_ntz'2015-05-01 00:00:00'"), F.lit(False))
    old, new = rows.where(~late), rows.where(late)
    stored = bitemporal_ledger(old, keys, "to_entity_id", "valid_from", micros("valid_to"), "transaction_time")
    return _ledger_rows(amended(stored, old, new, keys, "to_entity_id", "valid_from", micros("valid_to"), "transaction_time"))


def _ledger_rows(led: DataFrame) -> DataFrame:
    return led.select(
        "from_entity_id", "relation_type", F.col("value").alias("to_entity_id"), _shown("valid_from_us").alias("valid_from_at"),
        F.coalesce(_shown("valid_to_us"), F.lit("open")).alias("valid_to_at"), _shown("recorded_from_us").alias("recorded_from_at"),
        F.coalesce(_shown("recorded_to_us"), F.lit("open")).alias("recorded_to_at"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    v = versions(attribute_ledger(spark, d))
    return v.select("from_entity_id", "relation_type", F.col("value").alias("to_entity_id"), _shown("valid_from_us").alias("valid_from_at"), F.coalesce(_shown("valid_to_us"), F.lit("open")).alias("valid_to_at"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    x = covered(_statements(spark, d, False), ["from_entity_id"], "valid_from", "valid_to")
    return x.select("from_entity_id", "kind", _shown("start_us").alias("start_at"), F.coalesce(_shown("end_us"), F.lit("open")).alias("end_at"))


def _activity(spark: SparkSession, d: str) -> DataFrame:
    return gap_tree(table(spark, d, "episodes").select(user_key(F.col("user_id")).alias("user_id"), "ts", "id"), ["user_id"], "ts", "id")


def _session_rows(s: DataFrame) -> DataFrame:
    return s.select("user_id", F.date_format("session_start", MICRO).alias("session_start"), F.date_format("session_end", MICRO).alias("session_end"), F.col("n_events").alias("n_episodes"), "duration_s")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _session_rows(sessions(_activity(spark, d), SESSION_GAP_US)).drop("duration_s")


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _session_rows(sessions(_activity(spark, d), SESSION_GAP_US))


QUERIES = {"p2_found": p2_found, "p2_ledger": p2_ledger, "p2_amended": p2_amended, "p3_found": p3_found, "p5_found": p5_found, "p5_sessions": p5_sessions}

_KEY = "lower(regexp_replace({}, '[\\s_\\-]+', '', 'g'))"
_ROWS = f"""
  SELECT r.from_entity_id, t.relation_type, r.to_entity_id, r.valid_from AS f, r.transaction_time AS r,
         CASE WHEN year(r.valid_to) < 2100 THEN r.valid_to END AS t
  FROM relationships r JOIN relation_types t ON {_KEY.format('r.relation_type')} = {_KEY.format('t.relation_type')}
  WHERE t.single_valued = {{}} AND r.from_entity_id IS NOT NULL AND r.valid_from IS NOT NULL
    AND (r.valid_to IS NULL OR year(r.valid_to) >= 2100 OR r.valid_to > r.valid_from)"""
_SESSIONS = """
WITH e AS (SELECT DISTINCT ON (id) lower(trim(user_id)) AS user_id, ts FROM episodes ORDER BY id),
k AS (SELECT * FROM e WHERE user_id IS NOT NULL AND user_id <> '' AND ts IS NOT NULL),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS cut FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       count(*) AS n_episodes{} FROM s GROUP BY user_id, n"""
ORACLE = {
    "p2_found": f"""
WITH a AS ({_ROWS.format('true')}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_entity_id, relation_type, f ORDER BY r DESC, coalesce(t, TIMESTAMP '9999-01-01') DESC, to_entity_id DESC) AS n FROM a) WHERE n = 1),
c AS (SELECT *, least(coalesce(t, TIMESTAMP '9999-01-01'), coalesce(lead(f) OVER (PARTITION BY from_entity_id, relation_type ORDER BY f), TIMESTAMP '9999-01-01')) AS e FROM b),
d AS (SELECT *, CASE WHEN lag(to_entity_id) OVER w IS NOT DISTINCT FROM to_entity_id AND lag(e) OVER w = f THEN 0 ELSE 1 END AS cut FROM c WINDOW w AS (PARTITION BY from_entity_id, relation_type ORDER BY f)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY from_entity_id, relation_type ORDER BY f) AS i FROM d)
SELECT from_entity_id, relation_type, any_value(to_entity_id) AS to_entity_id, strftime(min(f), '%Y-%m-%d %H:%M:%S') AS valid_from_at,
       CASE WHEN max(e) >= TIMESTAMP '9999-01-01' THEN 'open' ELSE strftime(max(e), '%Y-%m-%d %H:%M:%S') END AS valid_to_at
FROM g GROUP BY from_entity_id, relation_type, i""",
    # Each statement is held from its recording until another of the same start; between, later ones that start after it cut it short.
    "p2_ledger": f"""
WITH a AS ({_ROWS.format('true')}),
b AS (SELECT * FROM (SELECT *, coalesce(r, TIMESTAMP '0001-01-01') AS rec, row_number() OVER (PARTITION BY from_entity_id, relation_type, f, r ORDER BY coalesce(t, TIMESTAMP '9999-01-01') DESC, to_entity_id DESC) AS n FROM a) WHERE n = 1),
c AS (SELECT *, lag(coalesce(t, TIMESTAMP '9999-01-01')) OVER w IS NOT DISTINCT FROM coalesce(t, TIMESTAMP '9999-01-01') AND lag(to_entity_id) OVER w IS NOT DISTINCT FROM to_entity_id AND lag(rec) OVER w IS NOT NULL AS same
      FROM b WINDOW w AS (PARTITION BY from_entity_id, relation_type, f ORDER BY rec)),
s AS (SELECT from_entity_id, relation_type, to_entity_id, f, t, rec, lead(rec) OVER (PARTITION BY from_entity_id, relation_type, f ORDER BY rec) AS until FROM c WHERE NOT same),
x AS (SELECT s.*, s.rec AS at_ FROM s UNION SELECT s.*, l.rec FROM s JOIN s l ON s.from_entity_id = l.from_entity_id AND s.relation_type = l.relation_type AND l.f > s.f AND l.rec > s.rec AND (s.until IS NULL OR l.rec < s.until)),
y AS (SELECT x.from_entity_id, x.relation_type, x.to_entity_id, x.f, x.t, x.rec, x.until, x.at_, least(coalesce(x.t, TIMESTAMP '9999-01-01'), coalesce(min(l.f), TIMESTAMP '9999-01-01')) AS e
      FROM x LEFT JOIN s l ON x.from_entity_id = l.from_entity_id AND x.relation_type = l.relation_type AND l.f > x.f AND l.rec <= x.at_ GROUP BY x.from_entity_id, x.relation_type, x.to_entity_id, x.f, x.t, x.rec, x.until, x.at_),
z AS (SELECT *, lag(e) OVER w IS DISTINCT FROM e AS new FROM y WINDOW w AS (PARTITION BY from_entity_id, relation_type, f, rec ORDER BY at_)),
k AS (SELECT *, coalesce(lead(at_) OVER (PARTITION BY from_entity_id, relation_type, f, rec ORDER BY at_), until) AS to_ FROM z WHERE new)
SELECT from_entity_id, relation_type, to_entity_id, strftime(f, '%Y-%m-%d %H:%M:%S') AS valid_from_at, CASE WHEN e >= TIMESTAMP '9999-01-01' THEN 'open' ELSE strftime(e, '%Y-%m-%d %H:%M:%S') END AS valid_to_at,
       strftime(at_, '%Y-%m-%d %H:%M:%S') AS recorded_from_at, coalesce(strftime(to_, '%Y-%m-%d %H:%M:%S'), 'open') AS recorded_to_at FROM k""",
    "p3_found": f"""
WITH a AS ({_ROWS.format('false')}),
b AS (SELECT DISTINCT from_entity_id, f, coalesce(t, TIMESTAMP '9999-01-01') AS e FROM a),
c AS (SELECT *, CASE WHEN f <= max(e) OVER (PARTITION BY from_entity_id ORDER BY f, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS cut FROM b),
g AS (SELECT *, sum(cut) OVER (PARTITION BY from_entity_id ORDER BY f, e ROWS UNBOUNDED PRECEDING) AS i FROM c),
p AS (SELECT from_entity_id, min(f) AS f, max(e) AS e FROM g GROUP BY from_entity_id, i),
x AS (SELECT from_entity_id, 'period' AS kind, f, e FROM p UNION ALL
      SELECT * FROM (SELECT from_entity_id, 'gap' AS kind, e AS f, lead(f) OVER (PARTITION BY from_entity_id ORDER BY f) AS e FROM p) WHERE e IS NOT NULL)
SELECT from_entity_id, kind, strftime(f, '%Y-%m-%d %H:%M:%S') AS start_at,
       CASE WHEN e >= TIMESTAMP '9999-01-01' THEN 'open' ELSE strftime(e, '%Y-%m-%d %H:%M:%S') END AS end_at FROM x""",
    "p5_found": _SESSIONS.format(""),
    "p5_sessions": _SESSIONS.format(", epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS duration_s").replace("epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6", "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6"),
}
ORACLE["p2_amended"] = ORACLE["p2_ledger"]
