"""From texts to episodes: words, their surprisal, an adaptive threshold, boundaries, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import count_tokens, fields, surprisal
from recollect.operators.halo import halo_chunks
from recollect.sources.tables import micros

WINDOW, GAMMA, MIN_TOKENS, MAX_TOKENS = 50, 2.5, 50, 500
TARGET_TURNS = 20_000


def spoken(turns: DataFrame) -> DataFrame:
    """(user_id, at, turn_id, w) of turns (turn_id, user_id, content, ts), ``w`` the words with their surprisal; rows without user, time
    or words are left out."""
    src = turns.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull() & F.col("content").isNotNull())
    src = src.select("user_id", micros("ts").alias("at"), "turn_id", fields(F.col("content")).alias("w")).where(F.size("w") > 0)
    return src.withColumn("w", F.transform("w", lambda x, i: F.struct(x.alias("word"), surprisal(x, F.when(i > 0, F.get("w", i - 1))).alias("s"))))


def words(turns: DataFrame) -> DataFrame:
    """(user_id, at, turn_id, pos, word, s): a row for each word."""
    return spoken(turns).select("user_id", "at", "turn_id", F.posexplode("w").alias("pos", "x")).select("user_id", "at", "turn_id", "pos", "x.word", "x.s")


def rolling(turns: DataFrame, window: int = WINDOW, gamma: float = GAMMA, target: int = TARGET_TURNS) -> DataFrame:
    """The words of turns with ``n``, ``mean``, ``sigma`` (population) over the last ``window`` words of the user, the current one included,
    across turns in order of (at, turn_id), and ``above``: s > mean + gamma sigma. The test is exact: in halves, all
    surprisals are whole numbers.

    Turns are shuffled whole, one row each, and become words where they have arrived. A hot user's are cut into chunks of ``target``
    turns; a turn has a word at least, so the last ``window`` - 1 turns before a chunk are all that it looks back to.
    """
    parts = halo_chunks(spoken(turns), ["user_id"], "at", ["at", "turn_id"], window - 1, target).repartition("user_id", "_chunk")
    x = parts.select("user_id", "_chunk", "_halo", "at", "turn_id", F.posexplode("w").alias("pos", "x")).select("user_id", "_chunk", "_halo", "at", "turn_id", "pos", "x.word", "x.s")
    w = Window.partitionBy("user_id", "_chunk").orderBy("at", "turn_id", "pos").rowsBetween(-(window - 1), 0)
    h = (F.col("s") * 2).cast("long")
    x = x.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("_a", F.sum(h).over(w)).withColumn("_b", F.sum(h * h).over(w))
    x = x.where(~F.col("_halo"))
    lead, spread = F.col("n") * h - F.col("_a"), F.col("n") * F.col("_b") - F.col("_a") * F.col("_a")
    x = x.withColumn("mean", F.col("_a") / F.col("n") / 2).withColumn("sigma", F.sqrt(spread) / F.col("n") / 2)
    return x.withColumn("above", (lead > 0) & (lead * lead > spread * (gamma * gamma))).drop("_a", "_b", "_halo")


def segments(tokens: DataFrame, least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """(user_id, at, turn_id, seg, content, n_tokens, avg_s, max_s) of ``rolling``'s rows.

    A boundary lies before a word that is above the threshold, ends a sentence and follows at least ``least`` words of its
    segment, and before any word that follows ``most``. The position of the last boundary is carried through the turn's words
    by a fold, as each decision depends on the one before. A turn is one row of the fold, so texts are whole.
    """
    able = F.col("above") & F.col("word").rlike("[.!?]$")
    # grouped by the chunk as well, by which the words are partitioned already
    turn = tokens.groupBy("user_id", "_chunk", "at", "turn_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "s", able.alias("able")))).alias("_w"))
    # only words that may be a boundary matter to the fold; the forced ones lie every ``most`` words after the last
    last = "element_at(b, -1)"
    forced = f"cast((x.pos - {last}) div {most} as int)"
    reached = f"({last} + {most} * {forced})"
    before = f"if({forced} > 0, concat(b, sequence({last} + {most}, {reached}, {most})), b)"
    fold = f"aggregate(filter(_w, x -> x.able), array(0), (b, x) -> if(x.pos - {reached} >= {least}, concat({before}, array(x.pos)), {before}))"
    tail = f"if(size(_w) - 1 - element_at(_b, -1) >= {most}, concat(_b, sequence(element_at(_b, -1) + {most}, size(_w) - 1, {most})), _b)"
    cut = turn.withColumn("_b", F.expr(fold)).withColumn("_b", F.expr(tail))
    piece = cut.select("user_id", "at", "turn_id", "_w", "_b", F.posexplode("_b").alias("seg", "_from"))
    piece = piece.withColumn("_p", F.expr("slice(_w, _from + 1, coalesce(get(_b, seg + 1), size(_w)) - _from)"))
    return piece.select(
        "user_id", "at", "turn_id", "seg", F.array_join(F.transform("_p", lambda x: x["word"]), " ").alias("content"), F.size("_p").alias("n_tokens"),
        (F.aggregate("_p", F.lit(0.0), lambda a, x: a + x["s"]) / F.size("_p")).alias("avg_s"), F.array_max(F.transform("_p", lambda x: x["s"])).alias("max_s"),
    )


def episodes(segs: DataFrame, role: str = "user", keep: list[str] = ()) -> DataFrame:
    """Episode rows with their defaults: importance is the surprisal, the larger of mean and maximum. Ids come from the
    natural key, so a rerun gives the same."""
    s = F.greatest("avg_s", "max_s")
    return segs.select(
        F.sha2(F.concat_ws("|", "user_id", "turn_id", "seg"), 256).alias("id"), "user_id", "content", "at", F.lit("episodic").alias("memory_type"),
        s.alias("importance_score"), F.lit("pending").alias("consolidation_status"), s.alias("surprisal_value"),
        F.lit(1.0).alias("decay_factor"), F.col("n_tokens").alias("token_count"), F.lit(role).alias("role"), *keep,
    )


def single_episode(turns: DataFrame) -> DataFrame:
    """A whole text as one episode of surprisal 1, the fallback where no probabilities are to be had."""
    return turns.select("turn_id", "user_id", "content", F.lit(1.0).alias("surprisal_value"), count_tokens(F.col("content")).alias("token_count"))
