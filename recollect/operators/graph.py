"""The knowledge graph: facts with validity, merging of entities, conflicts, traversal and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.chunks import TARGET_ROWS, time_chunks
from recollect.sources.tables import micros

DECAY = 0.95


def valid_at(as_of: Column, valid_to: str = "valid_to") -> Column:
    return F.col(valid_to).isNull() | (F.col(valid_to) > as_of)


def fact_text(s: str, p: str, o: str) -> Column:
    return F.concat_ws(" ", s, p, o)


def fact_sentence(s: str, p: str, o: str) -> Column:
    """A fact as content of a retrieval result."""
    return F.concat(F.concat_ws(" ", s, p, o), F.lit(". "))


def merge_entities(mentions: DataFrame) -> DataFrame:
    """Nodes of (name, user_id, at) mentions: created with the first, touched by the last; partial aggregates first."""
    return mentions.where("name is not null and user_id is not null").groupBy("name", "user_id").agg(F.min("at").alias("created_at"), F.max("at").alias("last_accessed"))


def resolve_conflicts(facts: DataFrame, keys: list[str], value: str, at: str, seq: str, decay: float = DECAY, target: int = TARGET_ROWS) -> DataFrame:
    """Closes every fact at the first later one of the same ``keys`` with another value, once, with its confidence times
    ``decay``; a repeated value opens a parallel fact. Adds ``closed_us`` (null: open) and ``new_confidence``.

    Order is (at, seq). A ``decay`` outside (0, 1) means DECAY. Hot keys are cut into chunks; a chunk takes over from
    the next ones the first fact and the first of another value than that, found in one pass over the chunks.
    """
    d = decay if 0 < decay < 1 else DECAY
    src = facts.withColumn("_at", micros(at)).where(F.col("_at").isNotNull())
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    parts, several = time_chunks(src, keys, "_at", target)
    by = [*keys, "_chunk"]
    w = Window.partitionBy(*by).orderBy("_at", seq)
    changed = ~F.lead(value).over(w).eqNullSafe(F.col(value)) & F.lead("_at").over(w).isNotNull()
    x = parts.withColumn("_next", F.when(changed, F.lead("_at").over(w)))
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    x = x.withColumn("closed_us", F.first("_next", ignorenulls=True).over(ahead))
    if several:
        order = F.struct("_at", seq)
        both = F.struct(F.col("_at").alias("at"), F.col(value).alias("v"))
        ends = x.groupBy(*by).agg(F.min_by(both, order).alias("_first"), F.max_by(both, order)["v"].alias("_last"))
        # the first change of value in a chunk, and where it begins with another value than the one before ended with
        second = x.where(F.col("_next").isNotNull()).groupBy(*by).agg(F.min("_next").alias("_second"))
        wk = Window.partitionBy(*keys).orderBy("_chunk")
        chain = ends.join(second, by, "left")
        border = F.when(F.lag("_chunk").over(wk).isNotNull() & ~F.lag("_last").over(wk).eqNullSafe(F.col("_first.v")), F.col("_first.at"))
        chain = chain.withColumn("_change", F.coalesce(border, "_second"))
        # of the next chunk: its first moment and value, and the first moment after that of another value
        chain = chain.withColumn("_then", F.coalesce(F.lead("_second").over(wk), F.first("_change", ignorenulls=True).over(wk.rowsBetween(2, Window.unboundedFollowing))))
        chain = chain.select(*by, F.lead("_first").over(wk).alias("_after"), "_then")
        x = x.join(chain, by, "left")
        other = F.when(F.col("_after.v").eqNullSafe(F.col(value)), F.col("_then")).otherwise(F.col("_after.at"))
        x = x.withColumn("closed_us", F.coalesce("closed_us", other)).drop("_after", "_then")
    closed = F.col("closed_us").isNotNull()
    return x.withColumn("new_confidence", F.when(closed, F.col("confidence") * d).otherwise(F.col("confidence"))).withColumn("new_decay_rate", F.when(closed, d).otherwise(1.0)).drop("_at", "_chunk", "_next")


def conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Facts of ``existing`` (user_id, subject, predicate, object, id) contradicted by ``incoming`` ones of the same
    subject and predicate: one row each, with the number of other values and the first and last of them. The values of a key are
    aggregated first, so a hot key forms no pairs."""
    keys = ["user_id", "subject", "predicate"]
    values = incoming.where("object is not null").groupBy(*keys, "object").agg(F.lit(1).alias("_one"))
    by = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("object").alias("_lo"), F.max("object").alias("_hi"))
    # of the first and last value themselves, the next ones
    lo2 = values.join(by, keys).where(F.col("object") > F.col("_lo")).groupBy(*keys).agg(F.min("object").alias("_lo2"))
    hi2 = values.join(by, keys).where(F.col("object") < F.col("_hi")).groupBy(*keys).agg(F.max("object").alias("_hi2"))
    x = existing.join(by.join(lo2, keys, "left").join(hi2, keys, "left"), keys).join(values, [*keys, "object"], "left")
    x = x.withColumn("others", F.col("_n") - F.coalesce("_one", F.lit(0))).where("others > 0")
    x = x.withColumn("first_other", F.when(F.col("object") == F.col("_lo"), F.col("_lo2")).otherwise(F.col("_lo")))
    x = x.withColumn("last_other", F.when(F.col("object") == F.col("_hi"), F.col("_hi2")).otherwise(F.col("_hi")))
    return x.drop("_n", "_lo", "_hi", "_lo2", "_hi2", "_one")


def traverse(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """The distinct facts within ``hops`` undirected steps of each query's seeds.

    ``edges``: (id, user_id, src, dst, ...), already valid; ``seeds``: (query, user_id, node). A fact is found if one end is
    at most hops - 1 steps away: joins on (user, node), unrolled, with distinct nodes in between, so repeated paths don't
    multiply.
    """
    ends = edges.select("user_id", F.col("src").alias("node"), F.col("dst").alias("to"))
    ends = ends.unionByName(edges.select("user_id", F.col("dst").alias("node"), F.col("src").alias("to"))).distinct()
    reached = seeds.select("query", "user_id", "node").distinct()
    for _ in range(hops - 1):
        step = reached.join(ends, ["user_id", "node"]).select("query", "user_id", F.col("to").alias("node"))
        reached = reached.unionByName(step).distinct()
    a = edges.join(reached.withColumnRenamed("node", "src"), ["user_id", "src"]).select("query", *edges.columns)
    b = edges.join(reached.withColumnRenamed("node", "dst"), ["user_id", "dst"]).select("query", *edges.columns)
    return a.unionByName(b).dropDuplicates(["query", "id"])


def insert_triples(nodes: DataFrame, edges: DataFrame, triples: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The graph after writing ``triples`` (user_id, subject, predicate, object, confidence, source_ep_id): (nodes, edges).

    Both ends of each triple become nodes (name, user_id, created_at, last_accessed) if they are none yet, else they are touched; each
    triple is a new edge, valid and recorded from ``now``, open, of decay rate 1. Ids come from the values, so a rerun gives the
    same. Triples without user, subject or object are left out; repeated ones are edges of their own.
    """
    t = triples.where("user_id is not null and subject is not null and object is not null")
    ends = t.select("user_id", F.col("subject").alias("name")).unionByName(t.select("user_id", F.col("object").alias("name"))).distinct()
    ends = ends.select("name", "user_id", now.alias("at"))
    both = nodes.select("name", "user_id", "created_at", "last_accessed").unionByName(ends.select("name", "user_id", F.col("at").alias("created_at"), F.col("at").alias("last_accessed")))
    merged = both.groupBy("name", "user_id").agg(F.min("created_at").alias("created_at"), F.max("last_accessed").alias("last_accessed"))
    number = F.row_number().over(Window.partitionBy("user_id", "subject", "predicate", "object").orderBy("source_ep_id", "confidence"))
    new = t.withColumn("_n", number).select(
        F.sha2(F.concat_ws("|", "user_id", "subject", "predicate", "object", "source_ep_id", now.cast("string"), "_n"), 256).alias("id"), "user_id",
        F.col("subject").alias("src"), "predicate", F.col("object").alias("dst"), "confidence", now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        now.alias("transaction_time"), "source_ep_id", F.lit(1.0).alias("decay_rate"),
    )
    return merged, edges.unionByName(new, allowMissingColumns=True)


def close_conflicts(edges: DataFrame, triples: DataFrame, now: Column, decay: float = DECAY) -> DataFrame:
    """``edges`` in which those that are open and contradicted by one of ``triples`` (same user, subject and predicate, another
    object) are closed at ``now`` with their confidence times ``decay``. Values of a key are compared as sets: an edge is contradicted
    unless its object is the only new one, so no pairs are formed."""
    d = decay if 0 < decay < 1 else DECAY
    new = triples.groupBy("user_id", F.col("subject").alias("src"), "predicate").agg(F.min("object").alias("_lo"), F.max("object").alias("_hi"))
    x = edges.join(new, ["user_id", "src", "predicate"], "left")
    hit = (F.col("valid_to").isNull() | (F.col("valid_to") > now)) & ((F.col("dst") != F.col("_lo")) | (F.col("dst") != F.col("_hi")))
    x = x.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    for c, v in (("valid_to", now), ("confidence", F.col("confidence") * d), ("decay_rate", F.lit(d))):
        if c in edges.columns:
            x = x.withColumn(c, F.when(F.col("_hit"), v).otherwise(F.col(c)))
    return x.select(*edges.columns)


def stats(nodes: DataFrame, active: DataFrame, mode: str = "reference") -> DataFrame:
    """Nodes and active facts per user. A fact counts for the user of its first node, whatever its own, and only between existing
    nodes. In reference mode a user without an active fact has no nodes either."""
    n = nodes.groupBy("user_id").agg(F.count(F.lit(1)).alias("nodes"))
    ends = nodes.select("id").distinct()
    e = active.join(nodes.select(F.col("id").alias("src"), F.col("user_id").alias("_owner")), "src").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = e.groupBy(F.col("_owner").alias("user_id")).agg(F.count(F.lit(1)).alias("edges"))
    x = n.join(e, "user_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    if mode == "reference":
        x = x.withColumn("nodes", F.when(F.col("edges") == 0, 0).otherwise(F.col("nodes")))
    return x.withColumn("density", F.coalesce(F.round(F.try_divide("edges", "nodes"), 2), F.lit(0.0)))
