"""The k most similar vectors of the same group for every vector: inverted lists scanned by adaptive dimension.

Vectors are normalised, rotated by one random orthogonal matrix and kept in column blocks. A scan adds up squared
distances block by block; after each, a test on the partial distance (as in ADSampling: after m of d dimensions,
a candidate within distance r lies below r sqrt(m/d) (1 + eps/sqrt(m)) almost surely) abandons most candidates. The distance
r is each query's own: that of its k-th neighbour so far, or of the least similarity asked for.

A group of up to LIST_ROWS rows is one list. A larger one has a list for about every PER_LIST rows, around coarse centroids that are
fitted on a bounded sample, a set of them for each power of two. Each vector is stored in its nearest list and looked up in
up to PROBES near ones, whatever the size of the group. Lists that come out long are cut into blocks, a task for each pair of stored
and asking block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST_ROWS = 8_192
PER_LIST = 4_096
PROBES = 8
TRAIN_ROWS = 32_768  # the bound of the sample that the coarse centroids are fitted on
MAX_LISTS = 1_024
EPSILON = 2.1
QUERY_TILE, LIST_TILE = 256, 2_048
SPARSE = 0.4  # up to this part of candidates left, they are looked at one by one

#: Pairs that scans of this process looked at, and those abandoned by a test on part of the dimensions.
counted = {"pairs": 0, "abandoned": 0}


@lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def usable(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``dim`` finite numbers, not all zero; those rows, of unit length in double precision."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ok = size == dim
    flat = col.filter(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        x = x / np.abs(x).max(1, initial=0, keepdims=True).clip(1e-300)
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0) & np.isfinite(x).all(1)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, x[good] / norm[good, None]


def _blocks(dim: int) -> list[tuple[int, int]]:
    """Quarters of the dimensions; after three of them the test is exact."""
    ends = [dim * n // 4 for n in range(5)] if dim >= 8 else [0, dim]
    return list(zip(ends, ends[1:]))


def scan(queries: np.ndarray, rows: np.ndarray, same: np.ndarray, k: int, least: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The up to ``k`` rows most similar to each query, of similarity ``least`` (one for all or one for each) or more: (query, row,
    similarity).

    ``same``: for each query the row that is itself, or -1. Equally similar rows rank by their position.
    """
    dim = rows.shape[1]
    least = np.broadcast_to(np.asarray(least, float), len(queries))
    rot = rotation(dim)
    q32, x32 = queries.astype(np.float32) @ rot, rows.astype(np.float32) @ rot
    blocks = _blocks(dim)
    cols = [np.ascontiguousarray(x32[:, a:b]) for a, b in blocks]
    square = [(c * c).sum(1) for c in cols]
    out: list[tuple] = []
    for at in range(0, len(queries), QUERY_TILE):
        q = q32[at : at + QUERY_TILE]
        qs = [(q[:, a:b] ** 2).sum(1) for a, b in blocks]
        floor = least[at : at + QUERY_TILE]
        bound = floor.copy()
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for lo in range(0, len(rows), LIST_TILE):
            hi = min(lo + LIST_TILE, len(rows))
            r2 = np.maximum(2 - 2 * bound, 0).astype(np.float32)
            i = j = part = None
            counted["pairs"] += len(q) * (hi - lo)
            for n, (a, b) in enumerate(blocks):
                last = b == dim
                limit = r2 * np.float32(1 if last else min(1.0, b / dim * (1 + EPSILON / math.sqrt(b)) ** 2)) + np.float32(1e-5)
                if i is None:
                    more = q[:, a:b] @ cols[n][lo:hi].T
                    more *= -2
                    more += square[n][lo:hi]
                    more += qs[n][:, None]
                    part = more if part is None else np.add(part, more, out=part)
                    if last and hi - lo > k + 1:  # no further than the tile's own k-th, itself left out
                        limit = np.minimum(limit, np.partition(part, k, axis=1)[:, k] + np.float32(1e-5))
                    mask = part <= limit[:, None]
                    if last or np.count_nonzero(mask) <= SPARSE * mask.size:
                        i, j = np.nonzero(mask)
                        left = part[i, j]
                        counted["abandoned"] += 0 if last else mask.size - len(i)
                else:
                    d = q[i, a:b] - cols[n][lo + j]
                    left = left + np.einsum("ij,ij->i", d, d)
                    m = left <= limit[i]
                    counted["abandoned"] += 0 if last else len(i) - np.count_nonzero(m)
                    i, j, left = i[m], j[m], left[m]
            m = same[at + i] != lo + j
            i, j, left = i[m], j[m] + lo, left[m]
            if len(i) > 4 * k * len(q):  # only what can still be among the k best needs the exact value
                order = np.lexsort((left, i))
                first = np.searchsorted(i[order], np.arange(len(q)))
                kth = np.minimum(first + k - 1, len(i) - 1)
                worst = np.where(i[order][kth] == np.arange(len(q)), left[order][kth] + np.float32(1e-5), np.inf)
                m = left <= worst[i]
                i, j = i[m], j[m]
            s = np.round(np.einsum("ij,ij->i", queries[at + i], rows[j]), 12)
            m = s >= floor[i]
            i, j, s = (np.concatenate([x, y[m]]) for x, y in zip(kept, (i, j, s)))
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            first = np.searchsorted(i, np.arange(len(q) + 1))
            m = np.arange(len(i)) - first[i] < k
            i, j, s = i[m], j[m], s[m]
            kept = (i, j, s)
            full = np.bincount(i, minlength=len(q)) >= k
            first = np.searchsorted(i, np.arange(len(q)))
            bound[full] = np.maximum(floor[full], s[first[full] + k - 1] - 1e-9)
        out.append((kept[0] + at, kept[1], kept[2]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _search(dim: int, k: int, least: float, schema: pa.Schema):
    """Of one list: rows with ``_role`` 1 are stored, 2 asked, 3 both; ``_bound``: the least similarity of use to who asks."""

    def run(table: pa.Table) -> pa.Table:
        ok, x = usable(table["_v"], dim)
        table = table.filter(pa.array(ok))
        ids, role = np.array(table["_id"].to_pylist(), object), table["_role"].to_numpy()
        bound = table["_bound"].to_numpy()
        order = np.argsort(ids, kind="stable") if len(ids) else np.zeros(0, np.int64)
        ids, role, bound, x = ids[order], role[order], bound[order], x[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else order
        if len(first):
            role, bound = np.bitwise_or.reduceat(role, first), np.maximum.reduceat(bound, first)
        ids, x = ids[first], x[first]
        stored, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        place = np.full(len(ids), -1)
        place[stored] = np.arange(len(stored))
        i, j, s = scan(x[asked], x[stored], place[asked], k, np.maximum(bound[asked], least))
        user = table["_user"][0] if table.num_rows else pa.scalar(None, pa.string())
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        return pa.table([pa.repeat(user, len(i)), pa.array(ids[asked[i]], pa.string()), pa.array(ids[stored[j]], pa.string()), pa.array(s), pa.array(rank, pa.int32())], schema=schema)

    return run


def _train(rows: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(3)
    c = rows[rng.choice(len(rows), min(lists, len(rows)), replace=False)]
    for _ in range(10):
        near = (rows @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, rows)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / norm.clip(1e-12)[:, None], c)
    return c


def coarse_sets(big: DataFrame, total: int, most: int, dim: int, per_list: int) -> dict[int, np.ndarray]:
    """Coarse centroids by number of lists, for groups of up to ``most`` rows; fitted on a sample of up to TRAIN_ROWS of the ``total`` rows
    of ``big``, which has those of large groups only."""
    sample = big.sample(min(1.0, 1.2 * TRAIN_ROWS / max(total, 1)), 11).limit(TRAIN_ROWS).select("_v").toArrow()
    _, rows = usable(sample["_v"], dim)
    if not len(rows):
        rows = np.eye(dim)[:1]
    top = lists_of(most, per_list)
    return {k: _train(rows, k) for k in (1 << e for e in range(1, top.bit_length()))}


def lists_of(rows: int, per_list: int) -> int:
    """The lists of a group: the power of two that gives each about ``per_list`` rows."""
    return min(MAX_LISTS, max(2, 1 << math.ceil(math.log2(max(rows / per_list, 1)))))


def routes(x: np.ndarray, n: np.ndarray, sets: dict[int, np.ndarray], per_list: int, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, whether it is the row's nearest) of up to ``probes`` lists within ``margin`` of the nearest, by the sizes ``n`` of
    the rows' groups."""
    out = []
    lists = np.array([lists_of(v, per_list) for v in n.tolist()])
    for k in np.unique(lists):
        rows = np.flatnonzero(lists == k)
        sim = x[rows] @ sets[int(k)].T
        top = np.argpartition(-sim, min(probes, sim.shape[1]) - 1, axis=1)[:, :probes]
        near = np.take_along_axis(sim, top, 1)
        best = near.max(1, keepdims=True)
        i, c = np.nonzero(near >= best - margin)
        home = top[np.arange(len(rows)), near.argmax(1)]
        out.append((rows[i], top[i, c], top[i, c] == home[i]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def nearest(df: DataFrame, group: str, id_col: str, vector: str, k: int = 5, least: float = -1.0, dim: int = 64, list_rows: int = LIST_ROWS, per_list: int = PER_LIST, probes: int = PROBES) -> DataFrame:
    """The up to ``k`` most similar vectors of the same group for every vector: (group, id, neighbour, similarity, rank).

    - Similarity is the cosine; pairs below ``least`` are left out. Equally similar neighbours rank by id.
    - Rows with a null group or id or an unusable vector (null, another length, not finite, all zero) have no
      neighbours and are none. An id that occurs again in its group counts once. A group of one has no rows in the result.
    - Groups of up to ``list_rows`` rows are searched but for the loss of the dimension test (below one in a hundred); of larger
      ones ``probes`` lists, so that a neighbour in a distant list can be missed. The README gives the recall measured.
    """
    src = df.select(F.col(group).cast("string").alias("_user"), F.col(id_col).cast("string").alias("_id"), F.col(vector).cast("array<float>").alias("_v"))
    src = src.where(F.col("_user").isNotNull() & F.col("_id").isNotNull() & (F.size("_v") == dim))
    out = "_user string, id string, neighbour string, similarity double, rank int"
    schema = pa.schema([("_user", pa.string()), ("id", pa.string()), ("neighbour", pa.string()), ("similarity", pa.float64()), ("rank", pa.int32())])
    search = _search(dim, k, least, schema)
    large = src.groupBy("_user").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > list_rows)
    found = large.agg(F.count(F.lit(1)).alias("groups"), F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    whole = src.withColumn("_role", F.lit(3)).withColumn("_bound", F.lit(-2.0))
    if not found["groups"]:
        return whole.groupBy("_user").applyInArrow(search, out).withColumnRenamed("_user", group)
    hint = F.broadcast if found["groups"] <= 20_000 else (lambda x: x)
    small = whole.join(hint(large.select("_user")), "_user", "left_anti").groupBy("_user").applyInArrow(search, out)
    big = src.join(hint(large), "_user")
    sets = src.sparkSession.sparkContext.broadcast(coarse_sets(big, found["rows"], found["most"], dim, per_list))
    # the similarity of near vectors to a centroid differs by about sqrt((2 - 2 least) / dim)
    margin = 2 * math.sqrt(2 * (2 - 2 * max(least, 0.3)) / dim)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = usable(b.column(2), dim)
            kept = b.filter(pa.array(ok))
            i, c, home = routes(x, kept.column(3).to_numpy(), sets.value, per_list, probes, margin)
            part = kept.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(c.astype(np.int32)), pa.array(np.where(home, 3, 2).astype(np.int32))], names=["_user", "_id", "_v", "_list", "_role"])

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in route(batches):
            t = pa.table([b.column(0), b.column(3), pa.array(b.column(4).to_numpy() == 3).cast(pa.int64())], names=["_user", "_list", "_home"])
            t = t.group_by(["_user", "_list"]).aggregate([("_home", "sum"), ("_home", "count")])
            yield from t.select(["_user", "_list", "_home_sum", "_home_count"]).rename_columns(["_user", "_list", "_stored", "_asked"]).to_batches()

    source = big.select("_user", "_id", "_v", "_n")
    routed = source.mapInArrow(route, "_user string, _id string, _v array<float>, _list int, _role int")
    # rows of a list may be many more than expected: cells hold one block of what it stores and one of those who ask
    of_list = source.mapInArrow(sizes, "_user string, _list int, _stored bigint, _asked bigint").groupBy("_user", "_list").agg(F.sum("_stored").alias("_stored"), F.sum("_asked").alias("_asked"))
    of_list = of_list.select("_user", "_list", F.greatest(F.ceil(F.col("_stored") / list_rows), F.lit(1)).cast("int").alias("_blocks"), F.ceil(F.col("_asked") / (4 * list_rows)).cast("int").alias("_asks"))
    if found["groups"] * lists_of(found["most"], per_list) <= 200_000:
        of_list = F.broadcast(of_list)

    def cells(rows: DataFrame) -> DataFrame:
        rows = rows.join(of_list, ["_user", "_list"])
        rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks"))).withColumn("_ask", F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_asks")))
        held = rows.where("(_role & 1) = 1").withColumn("_cell", F.explode(F.expr("transform(sequence(0, _asks - 1), a -> a * _blocks + _block)"))).withColumn("_role", F.lit(1))
        asks = rows.where("(_role & 2) = 2").withColumn("_cell", F.explode(F.expr("transform(sequence(0, _blocks - 1), b -> _ask * _blocks + b)"))).withColumn("_role", F.lit(2))
        cols = ["_user", "_list", "_cell", "_id", "_v", "_role", "_bound"]
        return held.select(*cols).unionByName(asks.select(*cols)).groupBy("_user", "_list", "_cell").applyInArrow(search, out)

    routed = routed.withColumn("_bound", F.lit(-2.0))
    if least >= 0.5:
        parts = cells(routed)
    else:
        # without a limit, who asks elsewhere brings the similarity of the k-th neighbour in the nearest list
        at_home = best_of(cells(routed.where("_role = 3")), k)
        kth = at_home.where(F.col("rank") == k).select("_user", F.col("id").alias("_id"), F.col("similarity").alias("_kth"))
        away = routed.where("_role = 2").join(kth, ["_user", "_id"], "left").withColumn("_bound", F.coalesce("_kth", F.lit(-2.0))).drop("_kth")
        parts = at_home.unionByName(cells(away.unionByName(routed.where("_role = 3").withColumn("_role", F.lit(1)))))
    return small.unionByName(best_of(parts, k)).withColumnRenamed("_user", group)


def best_of(parts: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each id, each neighbour once."""
    best = parts.groupBy("_user", "id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("s"), F.col("neighbour").alias("n")))), 1, k).alias("_b"))
    return best.select("_user", "id", F.posexplode("_b").alias("_p", "_x")).select("_user", "id", F.col("_x.n").alias("neighbour"), (-F.col("_x.s")).alias("similarity"), (F.col("_p") + 1).cast("int").alias("rank"))
