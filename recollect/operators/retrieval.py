"""Reading the memory: nearest episodes, fusion with facts, reranking by information gain, packing into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import count_tokens
from recollect.functions.vectors import dot, norm
from recollect.sources.tables import micros

TOP_K, FACT_LIMIT, BUDGET, TURNS, MIN_GAIN = 20, 50, 4_096, 3, -0.5
TURN_VALUE = 1_000.0


def top_k(episodes: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` episodes most similar to each query (query, user_id, vector) of its user: exact, similarity to nine places, ties by
    id; an id that is stored again counts once, and is dropped when its vector is no longer carried. The limit is applied before the shuffle as well (window group limit), so a hot user's rows are not all moved."""
    unit = queries.select("query", "user_id", "vector", norm(F.col("vector")).alias("_length"))
    x = episodes.join(unit, "user_id")
    score = F.round(dot(F.col("embedding"), F.col("vector")) / (norm(F.col("embedding")) * F.col("_length")), 9)
    x = x.withColumn("score", score).drop("vector", "embedding", "_length").dropDuplicates(["query", "id"])
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_results(vector: DataFrame, graph: DataFrame, mode: str = "reference") -> DataFrame:
    """(query, key, source, rank, score, content, ...): episodes first, then facts, each key once. In reference mode all
    facts share the key ``ep:``, so one fact per query remains, that of the highest confidence; in intended mode each
    distinct fact has its own, of its subject, predicate and object (columns of ``graph``)."""
    v = vector.withColumn("source", F.lit("vector")).withColumn("key", F.concat(F.lit("ep:"), F.col("id")))
    key = F.lit("ep:") if mode == "reference" else F.concat(F.lit("gf:"), F.concat_ws(":", "subject", "predicate", "object"), F.lit("|"))
    g = graph.withColumn("source", F.lit("graph")).withColumn("key", key)
    w = Window.partitionBy("query", "key").orderBy(F.desc("source"), "rank")  # vector before graph
    return v.unionByName(g, allowMissingColumns=True).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def information_gain(age_hours: Column) -> Column:
    """The heuristic gain of columns score, surprisal, importance, decay and confidence (null for no fact)."""
    s = F.coalesce("surprisal", F.lit(0.0))
    episode = F.col("score") + 0.3 * F.exp(-age_hours / 24) + F.when(s > 0, 0.2 * F.log1p(s) / 5).otherwise(0.0) + 0.1 * F.coalesce("importance", F.lit(0.0))
    return F.when(F.col("source") == "graph", 0.15 * F.col("confidence")).otherwise(episode * F.coalesce("decay", F.lit(0.0)))


def rerank(results: DataFrame, as_of: Column, least: float = MIN_GAIN, score: Column | None = None, fallback: bool = True) -> DataFrame:
    """Adds ``gain``, drops what has no content or not more than ``least``. ``as_of``: seconds since 1970. ``score``: the gain by a
    provider, null where it failed; there the heuristic stands in, or with ``fallback`` off the result is dropped."""
    second = F.floor(micros("ts") / 1_000_000)
    gain = information_gain((as_of - second) / 3600)
    if score is not None:
        gain = F.coalesce(score, gain) if fallback else score
    return results.where("content <> ''").withColumn("gain", gain).where(F.col("gain") > least)


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` turns per user by (ts, turn_id), ``back`` = 1 the latest; a turn delivered again counts once."""
    once = turns.where("user_id is not null and ts is not null").dropDuplicates(["turn_id"])
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("turn_id"))
    return once.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def knapsack(candidates: DataFrame, budgets: DataFrame, keys: list[str]) -> DataFrame:
    """The candidates packed into each key's budget.

    ``candidates``: keys, id, value, weight (bounded per key by the retrieval); ``budgets``: keys, budget, forced (weight of
    what is taken in any case). In order of density (ties by id), the first positive one that exceeds what is left sets
    the price below which nothing is taken; the rest is taken while it fits. Without room nothing is.
    """
    c = candidates.where("weight > 0").withColumn("density", F.col("value") / F.col("weight"))
    c = c.join(budgets.select(*keys, (F.col("budget") - F.col("forced")).alias("_room")), keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("density"), "id")
    c = c.where("_room > 0").withColumn("_sum", F.sum(F.when(F.col("density") > 0, F.col("weight")).otherwise(0)).over(w))
    whole = Window.partitionBy(*keys)
    broken = F.max(F.when((F.col("density") > 0) & (F.col("_sum") > F.col("_room")), F.col("density"))).over(whole)
    c = c.withColumn("_least", F.coalesce(F.greatest(broken - 1e-9, F.lit(0.0)), F.lit(0.0))).where(F.col("density") >= F.col("_least"))
    item = F.struct((-F.col("density")).alias("d"), "id", "weight", "value")
    g = c.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_i"), F.first("_room").alias("_room"))
    # only rows within 1e-9 of the price can fail to fit; a fold takes them while they do
    taken = F.expr(
        "aggregate(_i, named_struct('left', cast(_room as bigint), 'ids', cast(array() as array<struct<id: string, d: double, weight: bigint, value: double>>)), (a, x) -> "
        "if(x.weight <= a.left, named_struct('left', a.left - x.weight, 'ids', concat(a.ids, array(named_struct('id', x.id, 'd', -x.d, 'weight', cast(x.weight as bigint), 'value', x.value)))), a)).ids"
    )
    out = g.select(*keys, F.posexplode(taken).alias("_p", "_x"))
    return out.select(*keys, F.col("_x.id").alias("id"), (F.col("_p") + 1).alias("place"), F.col("_x.d").alias("density"), F.col("_x.weight").alias("weight"), F.col("_x.value").alias("value"))


def context_text(turns: Column, memories: Column, query: Column) -> Column:
    """The assembled context: turns, memories (arrays of strings) and the query, sections without content left out."""
    recent = F.concat(F.lit("## Recent Conversation\n"), F.array_join(F.transform(turns, lambda t: F.concat(t, F.lit("\n"))), ""), F.lit("\n"))
    memory = F.concat(F.lit("## Retrieved Memories\n"), F.array_join(F.transform(memories, lambda m, i: F.concat(F.lit("[Memory "), (i + 1).cast("string"), F.lit("] "), m, F.lit("\n"))), ""), F.lit("\n"))
    part = lambda arr, text: F.when(F.size(arr) > 0, text).otherwise("")
    return F.concat(part(turns, recent), part(memories, memory), F.lit("## Current Query\n"), query)


def weight(c: Column) -> Column:
    return count_tokens(c, 1).cast("long")
