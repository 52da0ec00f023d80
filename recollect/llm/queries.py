"""Queries of this subpackage by name, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.clusters import similarity_clusters
from recollect.llm.leaks import leaked_items
from recollect.llm.neighbours import nearest
from recollect.llm.packing import pack, token_counts
from recollect.llm.pii import learn, pii_items, redacted
from recollect.llm.splitting import pieces
from recollect.llm.subjects import subject_areas
from recollect.sources.tables import table, user_key

SIMILAR = 0.85


def _contents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").select(F.lit("episodes").alias("src"), F.col("id").alias("rec_id"), "content")
    t = table(spark, d, "turns").select(F.lit("turns").alias("src"), F.col("turn_id").cast("string").alias("rec_id"), "content")
    return e.unionByName(t)


def _key(spark: SparkSession) -> str:
    """The key of the surrogates; a deployment sets its own."""
    return spark.conf.get("spark.recollect.surrogate.key", "tests")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    learned = learn(_contents(spark, d), "content")
    e = pii_items(table(spark, d, "episodes"), "id", "content", _key(spark), learned).withColumn("src", F.lit("episodes"))
    t = pii_items(table(spark, d, "turns"), "turn_id", "content", _key(spark), learned).withColumn("src", F.lit("turns"))
    return e.unionByName(t).select("src", "rec_id", "pii_type", "start_pos")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts = _contents(spark, d)
    return redacted(texts, "content", _key(spark), learn(texts, "content"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes").select(user_key(F.col("user_id")).alias("user_id"), "id", "embedding")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(_vectors(spark, d), "user_id", "id", "embedding", 5, SIMILAR, probes=4)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(_vectors(spark, d), "user_id", "id", "embedding", 5)
    return near.select("user_id", "id", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces(table(spark, d, "episodes"), "id", "content")
    return cut.where("piece = 1").select(F.col("id").alias("episode_id")).distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces(table(spark, d, "episodes"), "id", "content").withColumnRenamed("id", "episode_id")


def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each episode amount to: without the overlaps they are the text, none is too long, and each but the first
    repeats some of the one before."""
    p = p6_pieces(spark, d).withColumn("new", F.expr("substring(content, cast(new_pos - start_pos as int) + 1)"))
    new = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "new"))), lambda x: x["new"]), "")
    repeats = F.min(F.when(F.col("piece") > 0, F.col("new_pos") > F.col("start_pos")))
    out = p.groupBy("episode_id").agg(F.md5(new).alias("text"), (F.max("n_tokens") <= 500).alias("fits"), (F.count(F.lit(1)) >= 2).alias("cut"), repeats.alias("overlaps"))
    return out


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return similarity_clusters(_vectors(spark, d), "user_id", "id", "embedding", SIMILAR)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select("cluster_id", F.col("id").alias("episode_id"))


def p7_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and the three most typical episodes of each cluster."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("similarity", 9)).alias("s"), "id"))), 1, 3)
    found = _clusters(spark, d).groupBy("user_id", "cluster_id").agg(F.max("size").alias("n_episodes"), best.alias("_b"))
    return found.select("user_id", "cluster_id", "n_episodes", F.concat_ws(",", F.col("_b.id")).alias("typical"))


def p8_contexts(spark: SparkSession, d: str) -> DataFrame:
    sized = token_counts(table(spark, d, "documents"), "doc_id", "text")
    return pack(sized).withColumnRenamed("id", "doc_id")


def p8_room(spark: SparkSession, d: str) -> DataFrame:
    """The contexts that p8_contexts fills, their tokens, the part of their room that stays unused, and the most and least of a step."""
    per = p8_contexts(spark, d).groupBy("step", "context").agg(F.sum("n_tokens").alias("n"))
    per = per.groupBy("step").agg(F.count(F.lit(1)).alias("n_contexts"), F.sum("n").alias("n"), F.max("n").alias("most"))
    out = per.agg(F.sum("n_contexts").alias("n_contexts"), F.sum("n").alias("n_tokens"), F.max("most").alias("fullest"), F.min("n").alias("step_least"), F.max("n").alias("step_most"))
    return out.withColumn("unused", F.round(1 - F.col("n_tokens") / (F.col("n_contexts") * 2_048), 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", F.concat_ws(" ", "passage", "question").alias("text"))
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", items, "item_id", "text").select("doc_id", "item_id")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    names = [r["subject"] for r in table(spark, d, "subjects").select("subject").where("subject is not null").orderBy("subject").collect()]
    labels = table(spark, d, "doc_labels").select(F.col("doc_id").alias("id"), "subject")
    return subject_areas(table(spark, d, "documents"), "doc_id", "text", labels, names).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Of each subject, the documents and the share of the corpus' documents."""
    n = table(spark, d, "documents").count()
    found = _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.avg("share"), 4).alias("mean_share"))
    return found.select("subject", "n_documents", F.round(F.col("n_documents") / max(n, 1), 4).alias("of_corpus"), "mean_share")


QUERIES = {
    "p1_found": p1_found, "p1_redacted": p1_redacted, "p4_found": p4_found, "p4_neighbours": p4_neighbours,
    "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_whole": p6_whole, "p7_found": p7_found, "p7_clusters": p7_clusters, "p8_contexts": p8_contexts, "p8_room": p8_room, "p9_found": p9_found,
    "p10_found": p10_found, "p10_composition": p10_composition,
}

_USABLE = """
u AS (SELECT DISTINCT ON (id) id, lower(trim(user_id)) AS user_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM episodes
      WHERE user_id IS NOT NULL AND trim(user_id) <> '' AND id IS NOT NULL AND len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
ORACLE = {
    "p4_found": f"""
WITH {_USABLE},
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.user_id = b.user_id AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 12) DESC, b) AS n FROM s WHERE s >= 0.85)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE n <= 5""",
    "p6_whole": "SELECT DISTINCT id AS episode_id, md5(content) AS text, true AS fits, true AS cut, true AS overlaps FROM episodes WHERE strlen(content) // 4 > 500",
    # where similar episodes are all similar to each other, a cluster is the smallest id of an episode and those near it
    "p7_found": f"""
WITH {_USABLE},
s AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.user_id = b.user_id WHERE a.id = b.id OR list_cosine_similarity(a.v, b.v) >= 0.85),
c AS (SELECT a AS episode_id, min(b) AS cluster_id FROM s GROUP BY a)
SELECT * FROM c WHERE cluster_id IN (SELECT cluster_id FROM c GROUP BY cluster_id HAVING count(*) >= 3)""",
    "p7_clusters": f"""
WITH {_USABLE},
s AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.user_id = b.user_id WHERE a.id = b.id OR list_cosine_similarity(a.v, b.v) >= 0.85),
c AS (SELECT a AS id, min(b) AS cluster_id FROM s GROUP BY a),
m AS (SELECT u.user_id, id, cluster_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS w, count(*) OVER (PARTITION BY cluster_id) AS n FROM c JOIN u USING (id)),
x AS (SELECT cluster_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM m WHERE n >= 3),
k AS (SELECT cluster_id, list(t ORDER BY p) AS centre FROM (SELECT cluster_id, p, sum(x) AS t FROM x GROUP BY cluster_id, p) GROUP BY cluster_id),
r AS (SELECT m.*, row_number() OVER (PARTITION BY cluster_id ORDER BY round(list_cosine_similarity(w, centre), 9) DESC, id) AS rank FROM m JOIN k USING (cluster_id))
SELECT user_id, cluster_id, max(n) AS n_episodes, string_agg(id, ',' ORDER BY rank) FILTER (rank <= 3) AS typical FROM r GROUP BY user_id, cluster_id""",
    "p4_neighbours": f"""
WITH {_USABLE},
s AS (SELECT a.user_id, a.id, b.id AS neighbour, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM u a JOIN u b ON a.user_id = b.user_id AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS rank FROM s)
SELECT user_id, id, neighbour, rank, round(s, 6) AS similarity FROM r WHERE rank <= 5""",
    "p6_found": "SELECT DISTINCT id AS episode_id FROM episodes WHERE strlen(content) // 4 > 500",
}
