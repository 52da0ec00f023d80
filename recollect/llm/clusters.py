"""Clusters of mutually similar vectors: cluster-feature trees, Ward agglomeration of their leaves, one assignment pass.

A cluster feature (CF) holds the number and the sum of unit vectors. Two of them give the mean similarity of all pairs between
them, (sum . sum) / (n n), so features are merged without their members.

A group of up to GROUP_ROWS rows is clustered in one task. Of a larger one, each task that reads rows builds a CF tree of its own; the
leaf features are united, again by CF trees, in lists around coarse centroids, in blocks first where a list has many; Ward
agglomeration joins the leaves of a list where the mean similarity between them reaches the limit; then one pass
assigns every row, in its nearest list, to the nearest of the centroids around. Last, the rows of a centroid are split exactly so that
any two of a cluster are similar; where they are many, block by block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import vectors as vx
from recollect.llm.neighbours import PER_LIST, coarse_sets, lists_of, routes, usable
from recollect.session import shared_checkpoint

GROUP_ROWS = 8_192
BUFFER_ROWS = 16_384
MAX_LEAVES = 32_768
CLUSTER_ROWS = 16_384
PROBES = 4
BRANCH = 96
TILE = 1_024


class CFTree:
    """Leaf entries are the features; each node keeps its children's sums in one matrix."""

    def __init__(self, dim: int, least: float):
        self.dim, self.least = dim, least
        self.root = self._node(True)
        self.n: list[float] = []
        self.total: list[np.ndarray] = []

    def _node(self, leaf: bool) -> dict:
        return {"leaf": leaf, "to": [], "m": np.zeros((BRANCH + 1, self.dim)), "w": np.zeros(BRANCH + 1)}

    def insert(self, x: np.ndarray, n: float = 1.0) -> int:
        """Add a unit vector of weight n, or a feature of n vectors with the sum x; returns the leaf entry."""
        node, path = self.root, []
        while True:
            size = len(node["to"])
            if size:
                score = node["m"][:size] @ x / node["w"][:size]
                at = int(score.argmax())
            if node["leaf"]:
                break
            path.append((node, at))
            node = node["to"][at]
        if size and score[at] / n >= self.least:
            entry = node["to"][at]
            self.n[entry] += n
            self.total[entry] += x
            node["m"][at] += x
            node["w"][at] += n
        else:
            entry = len(self.n)
            self.n.append(n)
            self.total.append(np.array(x, float))
            node["m"][size], node["w"][size] = x, n
            node["to"].append(entry)
        for parent, at in path:
            parent["m"][at] += x
            parent["w"][at] += n
        self._split(node, path)
        return entry

    def _split(self, node: dict, path: list) -> None:
        while len(node["to"]) > BRANCH:
            size = len(node["to"])
            m = node["m"][:size]
            unit = m / np.linalg.norm(m, axis=1, keepdims=True).clip(1e-12)
            a = int((unit @ unit[0]).argmin())
            b = int((unit @ unit[a]).argmin())
            right = unit @ unit[b] > unit @ unit[a]
            if right.all() or not right.any():
                right = np.arange(size) % 2 == 1
            halves = []
            for side in (~right, right):
                new = self._node(node["leaf"])
                k = int(side.sum())
                new["to"] = [t for t, s in zip(node["to"], side) if s]
                new["m"][:k], new["w"][:k] = m[side], node["w"][:size][side]
                halves.append(new)
            if path:
                parent, at = path.pop()
                parent["to"][at] = halves[0]
                new = len(parent["to"])
                parent["to"].append(halves[1])
            else:
                parent, at, new = self._node(False), 0, 1
                parent["to"] = halves
                self.root = parent
            for place, half in ((at, halves[0]), (new, halves[1])):
                k = len(half["to"])
                parent["m"][place], parent["w"][place] = half["m"][:k].sum(0), half["w"][:k].sum()
            node = parent


def leaves(x: np.ndarray, n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The leaf features of a CF tree over features (sums x of n unit vectors)."""
    tree = CFTree(x.shape[1], least)
    for row, k in zip(x, n):
        tree.insert(row, k)
    return np.array(tree.total).reshape(-1, x.shape[1]), np.array(tree.n)


def joinable(x: np.ndarray, n: np.ndarray, block: np.ndarray, least: float, smallest: int) -> np.ndarray:
    """Which features of one or two blocks can be in a cluster: those of ``smallest`` rows, and those with a mean similarity of
    ``least`` to another of the other block, or of the only one. The mean similarity of united features is an average of that of
    their parts, so a feature with none that near joins none, whatever is united before."""
    keep = n >= smallest
    if not len(n):
        return keep
    a, b = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    centre = (x / n[:, None]).astype(np.float32)
    other = centre[b]
    tile = _tile(len(b))
    for lo in range(0, len(a), tile):
        rows = a[lo : lo + tile]
        near = centre[rows] @ other.T >= least - 1e-5
        near &= rows[:, None] != b
        keep[rows] |= near.any(1)
        keep[b] |= near.any(0)
    return keep


def ward(x: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Agglomerates features in order of Ward's cost where the mean similarity of the pairs between them is ``least`` or more;
    returns the cluster of each feature."""
    size = len(n)
    parent = np.arange(size)
    if size < 2:
        return parent
    centre = x / n[:, None]
    near: dict[int, set[int]] = {}
    heap = []
    unit = (centre / np.linalg.norm(centre, axis=1, keepdims=True).clip(1e-12)).astype(np.float32)
    tile = _tile(size)
    for lo in range(0, size, tile):
        i, j = np.nonzero(unit[lo : lo + tile] @ unit[lo:].T >= least - 0.05)
        for a, b in zip((i + lo).tolist(), (j + lo).tolist()):
            if a < b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
                heap.append((_cost(x, n, a, b), a, b, n[a] + n[b]))
    x, n = x.copy(), n.copy()
    heapq.heapify(heap)
    alive = np.ones(size, bool)
    while heap:
        _, a, b, total = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or total != n[a] + n[b]:
            continue
        if x[a] @ x[b] < least * n[a] * n[b]:
            continue
        x[a], n[a] = x[a] + x[b], n[a] + n[b]
        alive[b] = False
        parent[b] = a
        others = (near.pop(a, set()) | near.pop(b, set())) - {a, b}
        near[a] = {o for o in others if alive[o]}
        for o in near[a]:
            near[o].discard(b)
            near[o].add(a)
            heapq.heappush(heap, (_cost(x, n, a, o), *sorted((a, o)), n[a] + n[o]))
    for i in range(size):
        while parent[i] != parent[parent[i]]:
            parent[i] = parent[parent[i]]
    return parent


def _tile(columns: int) -> int:
    """Rows of a block of products with so many columns that it stays small."""
    return max(16, min(TILE, (1 << 25) // max(columns, 1)))


def _cost(x: np.ndarray, n: np.ndarray, a: int, b: int) -> float:
    d = x[a] / n[a] - x[b] / n[b]
    return float(n[a] * n[b] / (n[a] + n[b]) * (d @ d))


def centroids(x: np.ndarray, n: np.ndarray, least: float, smallest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sizes of the clusters of features, of those with at least ``smallest`` rows."""
    label = ward(x, n, least)
    keep, at = np.unique(label, return_inverse=True)
    total = np.zeros((len(keep), x.shape[1]))
    np.add.at(total, at, x)
    size = np.bincount(at, n, len(keep))
    return total[size >= smallest], size[size >= smallest]


def assign(x: np.ndarray, total: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the similarity to it; -1 where the mean similarity to its members isn't near
    ``least``."""
    norm = np.linalg.norm(total, axis=1).clip(1e-12)
    unit = (total / norm[:, None]).astype(np.float32)
    label, sim = np.full(len(x), -1), np.zeros(len(x))
    x32 = x.astype(np.float32)
    if not len(total):
        return label, sim
    tile = _tile(len(total))
    for lo in range(0, len(x), tile):
        s = x32[lo : lo + tile] @ unit.T
        label[lo : lo + tile] = best = s.argmax(1)
        sim[lo : lo + tile] = s[np.arange(len(best)), best]
    label[sim < least - 0.05] = -1
    return label, sim


def mutual(x: np.ndarray, least: float) -> np.ndarray:
    """Splits rows so that any two of a part have similarity ``least`` or more: one part if they have already; else the row
    in most pairs below it leaves (of equals the last) until none remains, and those that left are split in turn."""
    label, todo, part = np.zeros(len(x), int), np.arange(len(x)), 0
    limit = least - 1e-9
    while len(todo):
        y = x[todo]
        below = np.concatenate([(y[lo : lo + TILE] @ y.T < limit).sum(1) for lo in range(0, len(y), TILE)])
        stays = np.ones(len(y), bool)
        while True:
            worst = len(y) - 1 - int(np.where(stays, below, -1)[::-1].argmax())
            if below[worst] <= 0 or not stays[worst]:
                break
            stays[worst] = False
            below -= y @ y[worst] < limit
        label[todo[stays]] = part
        part += 1
        todo = todo[~stays]
    return label


def _members(ids: np.ndarray, x: np.ndarray, label: np.ndarray, least: float, smallest: int) -> Iterator[tuple]:
    """(cluster id, ids, similarity to the centroid) of each cluster; rows in order of id."""
    order = np.lexsort((np.arange(len(ids)), label))
    cut = np.flatnonzero(np.diff(label[order])) + 1
    for rows in np.split(order, cut):
        if len(rows) < smallest or label[rows[0]] < 0:
            continue
        once, _, back = _distinct(x[rows]) if len(rows) > 64 else (x[rows], None, slice(None))
        parts = mutual(once, least)[back]
        for p in np.unique(parts):
            own = rows[parts == p]
            if len(own) >= smallest:
                c = x[own].sum(0)
                yield ids[own[0]], ids[own], x[own] @ c / np.linalg.norm(c)


_OUT = "_user string, cluster_id string, id string, similarity double, size bigint"
_SCHEMA = pa.schema([("_user", pa.string()), ("cluster_id", pa.string()), ("id", pa.string()), ("similarity", pa.float64()), ("size", pa.int64())])


def _rows(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order, each once, and their vectors."""
    ok, x = usable(table["_v"], dim)
    ids = np.array(table["_id"].filter(pa.array(ok)).to_pylist(), object)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    once = np.ones(len(ids), bool)
    once[1:] = ids[1:] != ids[:-1]
    return ids[once], x[once]


def _table(user, found) -> pa.Table:
    cols: list[list] = [[], [], [], [], []]
    for cid, ids, sim in found:
        for c, v in zip(cols, ([user] * len(ids), [cid] * len(ids), ids, sim, [len(ids)] * len(ids))):
            c.extend(v)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _features(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sizes in order of their values: a shuffle gives rows in any order, and all parts of a group must number
    the same centroids alike."""
    col = table["_s"].combine_chunks()
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    x, n = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), table["_w"].to_numpy()
    key = np.ascontiguousarray(np.column_stack([x, n]))
    order = np.argsort(key.view(np.dtype((np.void, key.dtype.itemsize * (dim + 1)))).reshape(-1), kind="stable")
    return x[order], n[order]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal vectors once: (vectors, how often, place of each row)."""
    if not len(x):
        return x, np.zeros(0), np.zeros(0, int)
    key = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).reshape(-1)
    _, at, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    rank = np.empty(len(at), int)
    rank[order] = np.arange(len(at))
    return x[at[order]], n[order].astype(float), rank[back.reshape(-1)]


def similarity_clusters(
    df: DataFrame, group: str, id_col: str, vector: str, least: float = 0.85, smallest: int = 3, dim: int = 64,
    group_rows: int = GROUP_ROWS, max_leaves: int = MAX_LEAVES, per_list: int = PER_LIST, cluster_rows: int = CLUSTER_ROWS,
) -> DataFrame:
    """Members of each cluster: (group, cluster_id, id, similarity, size).

    A cluster is a set of at least ``smallest`` ids of one group any two of which have cosine ``least`` or more;
    ``cluster_id`` is its smallest id, ``similarity`` a member's to the centroid. Clusters don't share members.

    - Rows with a null group or id or an unusable vector (null, another length, not finite, all zero) are in no cluster;
      an id that occurs again in its group counts once; equal vectors are clustered once and all their ids are members.
    - Groups of more than ``group_rows`` rows are summarised in several tasks and united by their features. A list of more than
      ``max_leaves`` features is first compared in pairs of blocks, to drop those that can be in no cluster; a centroid with more than
      ``cluster_rows`` rows has them compared in pairs of blocks.
    """
    src = df.select(F.col(group).cast("string").alias("_user"), F.col(id_col).cast("string").alias("_id"), F.col(vector).cast("array<float>").alias("_v"))
    src = src.where(F.col("_user").isNotNull() & F.col("_id").isNotNull() & (F.size("_v") == dim))
    large = src.groupBy("_user").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_rows)

    def whole(table: pa.Table) -> pa.Table:
        ids, x = _rows(table, dim)
        if len(ids) < smallest:
            return _table(None, [])
        once, n, back = _distinct(x)
        total, _ = centroids(*leaves(once * n[:, None], n, least), least, smallest)
        label, _ = assign(once, total, least)
        return _table(table["_user"][0].as_py(), _members(ids, x, label[back], least, smallest))

    found = large.agg(F.count(F.lit(1)).alias("groups"), F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    if not found["groups"]:
        return src.groupBy("_user").applyInArrow(whole, _OUT).withColumnRenamed("_user", group)
    hint = F.broadcast if found["groups"] <= 20_000 else (lambda x: x)
    small = src.join(hint(large.select("_user")), "_user", "left_anti").groupBy("_user").applyInArrow(whole, _OUT)
    big = src.join(hint(large), "_user").select("_user", "_id", "_v", "_n")
    sets = coarse_sets(big, found["rows"], found["most"], dim, per_list)
    return small.unionByName(_large(big, sets, least, smallest, dim, max_leaves, per_list, cluster_rows)).withColumnRenamed("_user", group)


_FEATURE = "_user string, _n bigint, _list int, _f bigint, _w double, _s array<double>"
_FEATURE_SCHEMA = pa.schema([("_user", pa.string()), ("_n", pa.int64()), ("_list", pa.int32()), ("_f", pa.int64()), ("_w", pa.float64()), ("_s", pa.list_(pa.float64()))])


def _sums(column, dim: int) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pack(user, n, lists, total: np.ndarray, w: np.ndarray) -> pa.Table:
    """Rows of features; ``lists``: one list for all or of each."""
    k, dim = len(w), total.shape[1] if total.ndim == 2 else 1
    off = pa.array(np.arange(0, (k + 1) * dim, dim, dtype=np.int32)[: k + 1])
    number = np.arange(k) + (np.int64(lists if np.isscalar(lists) else 0) << 32)
    return pa.table(
        [pa.array([user] * k, pa.string()), pa.array([n] * k, pa.int64()), pa.array(np.broadcast_to(lists, k).astype(np.int32)), pa.array(number), pa.array(w, pa.float64()), pa.ListArray.from_arrays(off, pa.array(total.reshape(-1), pa.float64()))],
        schema=_FEATURE_SCHEMA,
    )


def _large(big: DataFrame, sets: dict[int, np.ndarray], least: float, smallest: int, dim: int, max_leaves: int, per_list: int, cluster_rows: int) -> DataFrame:
    shared = big.sparkSession.sparkContext.broadcast(sets)
    margin = 2 * math.sqrt(2 * (2 - 2 * least) / dim)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaves of the trees of a task's rows, one tree for each group and up to BUFFER_ROWS rows."""
        held: dict[str, list] = {}

        def flush(user: str) -> Iterator[pa.RecordBatch]:
            n, _, xs = held.pop(user)
            once, w, _ = _distinct(np.concatenate(xs))
            yield from _pack(user, n, 0, *leaves(once * w[:, None], w, least)).to_batches()

        for b in batches:
            ok, x = usable(b.column(1), dim)
            b = b.filter(pa.array(ok))
            users = b.column(0).dictionary_encode()
            code = users.indices.to_numpy()
            for u in np.unique(code):
                at = np.flatnonzero(code == u)
                user = users.dictionary[int(u)].as_py()
                entry = held.setdefault(user, [b.column(2)[int(at[0])].as_py(), 0, []])
                entry[1] += len(at)
                entry[2].append(x[at])
                if entry[1] >= BUFFER_ROWS:
                    yield from flush(user)
            while sum(e[1] for e in held.values()) >= 4 * BUFFER_ROWS:
                yield from flush(max(held, key=lambda u: held[u][1]))
        for user in list(held):
            yield from flush(user)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features in all lists near their centroids."""
        for b in batches:
            x = _sums(b.column(5), dim)
            i, c, _ = routes(x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-12), b.column(1).to_numpy(), shared.value, per_list, PROBES, margin)
            part = b.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(c.astype(np.int32)), *part.columns[3:]], schema=_FEATURE_SCHEMA)

    def first(table: pa.Table, c: str):
        return table[c][0].as_py() if table.num_rows else None

    def unite(table: pa.Table) -> pa.Table:
        return _pack(first(table, "_user"), first(table, "_n"), first(table, "_list") or 0, *leaves(*_features(table, dim), least))

    def homes(total: np.ndarray, n: int) -> np.ndarray:
        unit = total / np.linalg.norm(total, axis=1, keepdims=True).clip(1e-12)
        return (unit @ shared.value[lists_of(n, per_list)].T).argmax(1)

    def agglomerate(table: pa.Table) -> pa.Table:
        """The clusters of one list's leaves, each in the list its centroid is at home in; a number of more than 0 tells that it was not
        found there."""
        if not table.num_rows:
            return _pack(None, None, 0, np.zeros((0, dim)), np.zeros(0))
        own, n = first(table, "_list"), first(table, "_n")
        total, w = centroids(*_features(table, dim), least, smallest)
        at = homes(total, n) if len(total) else np.zeros(0, int)
        out = _pack(first(table, "_user"), n, at, total, w)
        return out.set_column(3, _FEATURE_SCHEMA.field(3), pa.array((at != own).astype(np.int64)))

    def settle(table: pa.Table) -> pa.Table:
        """A list's own clusters, and those of other lists that it has not found itself."""
        if not table.num_rows:
            return _pack(None, None, 0, np.zeros((0, dim)), np.zeros(0))
        own = table["_f"].to_numpy() == 0
        mine, w = _features(table.filter(pa.array(own)), dim)
        theirs, v = _features(table.filter(pa.array(~own)), dim)
        unit = lambda t: t / np.linalg.norm(t, axis=1, keepdims=True).clip(1e-12)
        for i in np.argsort(-v, kind="stable"):
            if not len(mine) or (unit(mine) @ unit(theirs[i : i + 1])[0]).max() < least:
                mine, w = np.concatenate([mine, theirs[i : i + 1]]), np.append(w, v[i])
        return _pack(first(table, "_user"), first(table, "_n"), first(table, "_list"), mine, w)

    def prune(table: pa.Table) -> pa.Table:
        keep = joinable(_sums(table["_s"], dim), table["_w"].to_numpy(), table["_block"].to_numpy(), least, smallest)
        return table.select(_FEATURE_SCHEMA.names).filter(pa.array(keep)).cast(_FEATURE_SCHEMA)

    level = big.select("_user", "_v", "_n").mapInArrow(build, _FEATURE)
    level = level.withColumn("_f", F.monotonically_increasing_id())
    # each feature in several lists, united in blocks first; then as many as are left are counted
    routed = level.mapInArrow(spread, _FEATURE).withColumn("_block", F.pmod(F.xxhash64("_f"), F.lit(4)))
    routed = routed.groupBy("_user", "_list", "_block").applyInArrow(unite, _FEATURE)
    routed = shared_checkpoint(routed.withColumn("_f", F.monotonically_increasing_id()))
    over = routed.groupBy("_user", "_list").agg(F.ceil(2 * F.count(F.lit(1)) / max_leaves).cast("int").alias("_blocks")).where("_blocks > 2")
    n_over = over.count()
    if n_over:
        hint = F.broadcast if n_over <= 20_000 else (lambda x: x)
        split = routed.join(hint(over), ["_user", "_list"]).withColumn("_block", F.pmod(F.xxhash64("_f"), F.col("_blocks")).cast("int"))
        split = split.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        split = split.withColumn("_lo", F.least("_block", "_other")).withColumn("_hi", F.greatest("_block", "_other"))
        split = split.select(*_FEATURE_SCHEMA.names, "_block", "_lo", "_hi").groupBy("_user", "_list", "_lo", "_hi").applyInArrow(prune, _FEATURE)
        kept = split.dropDuplicates(["_user", "_list", "_f"])
        routed = routed.join(hint(over.select("_user", "_list")), ["_user", "_list"], "left_anti").select(*_FEATURE_SCHEMA.names).unionByName(kept)
    found = routed.groupBy("_user", "_list").applyInArrow(agglomerate, _FEATURE).groupBy("_user", "_list").applyInArrow(settle, _FEATURE)
    around = found.mapInArrow(spread, _FEATURE)
    labelled = pa.schema([("_user", pa.string()), ("_id", pa.string()), ("_v", pa.list_(pa.float32())), ("_label", pa.int64())])

    def home(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = usable(b.column(2), dim)
            b = b.filter(pa.array(ok))
            i, c, _ = routes(x, b.column(3).to_numpy(), shared.value, per_list, 1, margin)
            part = b.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(c.astype(np.int32))], names=["_user", "_id", "_v", "_list"])

    def place(rows: pa.Table, centres: pa.Table) -> pa.Table:
        ok, x = usable(rows["_v"], dim)
        rows = rows.filter(pa.array(ok))
        if centres.num_rows:
            centres = centres.sort_by("_f")
            label, _ = assign(x, _sums(centres["_s"], dim), least)
            number = centres["_f"].to_numpy()[np.maximum(label, 0)]
        else:
            label = number = np.full(len(x), -1)
        keep = pa.array(label >= 0)
        return pa.table([rows["_user"].filter(keep), rows["_id"].filter(keep), rows["_v"].filter(keep), pa.array(number[label >= 0].astype(np.int64))], schema=labelled)

    at_home = big.mapInArrow(home, "_user string, _id string, _v array<float>, _list int")
    placed = at_home.groupBy("_user", "_list").cogroup(around.groupBy("_user", "_list")).applyInArrow(place, "_user string, _id string, _v array<float>, _label bigint")
    return _split(shared_checkpoint(placed), least, smallest, dim, cluster_rows)


def _split(placed: DataFrame, least: float, smallest: int, dim: int, cluster_rows: int) -> DataFrame:
    """The clusters among the rows of each centroid."""

    def members(table: pa.Table) -> pa.Table:
        ids, x = _rows(table, dim)
        return _table(table["_user"][0].as_py() if table.num_rows else None, _members(ids, x, np.zeros(len(ids), int), least, smallest))

    keys = ["_user", "_label"]
    large = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > cluster_rows)
    n_large = large.count()
    if not n_large:
        return placed.groupBy(*keys).applyInArrow(members, _OUT)
    hint = F.broadcast if n_large <= 20_000 else (lambda x: x)
    few = placed.join(hint(large.select(*keys)), keys, "left_anti").groupBy(*keys).applyInArrow(members, _OUT)

    # of large ones, how many others each row is too far from, block by block; rows that are near all others need no further look
    def below(table: pa.Table) -> pa.Table:
        ids, x = _rows(table.filter(pa.array(table["_mine"].to_numpy(zero_copy_only=False))), dim)
        _, y = _rows(table, dim)
        n = np.concatenate([(x[lo : lo + TILE] @ y.T < least - 1e-9).sum(1) for lo in range(0, len(x), TILE)]) if len(x) else np.zeros(0, np.int64)
        return pa.table({"_user": pa.repeat(table["_user"][0], len(ids)), "_label": pa.repeat(table["_label"][0], len(ids)), "_id": pa.array(ids, pa.string()), "_below": pa.array(n.astype(np.int64))})

    def parts(table: pa.Table) -> pa.Table:
        ids, x = _rows(table, dim)
        return pa.table({"_user": pa.repeat(table["_user"][0], len(ids)), "_label": pa.repeat(table["_label"][0], len(ids)), "_id": pa.array(ids, pa.string()), "_part": pa.array(mutual(x, least).astype(np.int32))})

    once = placed.join(hint(large), keys).dropDuplicates(["_user", "_label", "_id"])
    once = once.withColumn("_blocks", F.ceil(F.col("_k") / cluster_rows).cast("int")).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    cells = once.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    both = cells.select(*keys, F.col("_block").alias("_a"), F.col("_other").alias("_b"), F.lit(True).alias("_mine"), "_id", "_v")
    both = both.unionByName(cells.where("_other <> _block").select(*keys, F.col("_other").alias("_a"), F.col("_block").alias("_b"), F.lit(False).alias("_mine"), "_id", "_v"))
    far = both.groupBy(*keys, "_a", "_b").applyInArrow(below, "_user string, _label bigint, _id string, _below bigint")
    far = far.groupBy(*keys, "_id").agg(F.sum("_below").alias("_below")).where("_below > 0")
    odd = once.join(far, [*keys, "_id"]).select(*keys, "_id", "_v").groupBy(*keys).applyInArrow(parts, "_user string, _label bigint, _id string, _part int")
    marked = once.select(*keys, "_id", "_v").join(odd, [*keys, "_id"], "left").withColumn("_part", F.coalesce("_part", F.lit(0)))
    unit = marked.withColumn("_norm", vx.norm(F.col("_v"))).withColumn("_v", F.transform("_v", lambda x: x.cast("double") / F.col("_norm")))
    whole = unit.groupBy(*keys, "_part").agg(F.min("_id").alias("cluster_id"), F.count(F.lit(1)).alias("size"), vx.mean("_v", dim).alias("_c")).where(F.col("size") >= smallest)
    many = unit.join(whole, [*keys, "_part"]).select("_user", "cluster_id", F.col("_id").alias("id"), vx.cosine_similarity(F.col("_v"), F.col("_c")).alias("similarity"), "size")
    return few.unionByName(many)
