"""Neighbours and clusters against brute force, with groups in one task and split over several."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import clusters, neighbours
from recollect.llm.clusters import similarity_clusters
from recollect.llm.neighbours import nearest

DIM = 16


def data(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for u, n in (("a", 90), ("b", 12), ("c", 1)):
        centres = rng.standard_normal((n // 5 + 1, DIM))
        for i in range(n):
            v = centres[i % len(centres)] + 0.12 * rng.standard_normal(DIM) * (i % 7 != 0)
            rows.append((u, f"{u}{i:03d}", (v * rng.uniform(0.5, 3)).astype(np.float32).tolist(), 0.0))
    bad = [("a", "z1", None, 0.0), ("a", "z2", [0.0] * DIM, 0.0), ("a", "z3", [float("nan")] * DIM, 0.0), ("a", "z4", [1.0], 0.0), (None, "z5", rows[0][2], 0.0), ("a", None, rows[0][2], 0.0), ("a", "z6", [float("inf")] + [1.0] * (DIM - 1), 0.0)]
    return rows, bad


def similarities(rows):
    ids = [r[1] for r in rows]
    x = np.array([r[2] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if a[0] != b[0] or i == j:
                s[i, j] = -9
    return ids, s


SCHEMA = "user string, id string, vec array<float>, similarity double"


@pytest.mark.parametrize("least,list_rows", [(-1.0, 10_000), (0.85, 10_000), (0.85, 30), (-1.0, 30)])
def test_nearest(spark, least, list_rows):
    rows, bad = data()
    df = spark.createDataFrame(rows + rows[:9] + bad, SCHEMA)
    ids, s = similarities(rows)
    want = set()
    for i, a in enumerate(ids):
        best = sorted((-round(s[i, j], 12), b) for j, b in enumerate(ids) if s[i, j] >= max(least, -1.5))[:5]
        want |= {(a, b) for _, b in best}
    got = nearest(df, "user", "id", "vec", 5, least, DIM, list_rows, list_rows // 2).collect()
    pairs = {(x.id, x.neighbour) for x in got}
    assert len(pairs) == len(got)
    if list_rows > 1000:
        assert pairs == want
    else:
        assert len(pairs & want) >= 0.9 * len(want)
    assert nearest(df.where("false"), "user", "id", "vec", 5, least, DIM).count() == 0


@pytest.mark.parametrize("group_rows,cluster_rows", [(10_000, 10_000), (25, 10_000), (25, 2)])
def test_clusters(spark, group_rows, cluster_rows):
    rows, bad = data(3)
    rows += [("a", f"dup{i}", rows[0][2], 0.0) for i in range(4)]
    df = spark.createDataFrame(rows + rows[:9] + bad, SCHEMA)
    got = similarity_clusters(df, "user", "id", "vec", 0.85, 3, DIM, group_rows, per_list=12, cluster_rows=cluster_rows).collect()
    ids, s = similarities(rows)
    at = {i: k for k, i in enumerate(ids)}
    groups = {}
    for x in got:
        groups.setdefault(x.cluster_id, []).append(x.id)
        assert x.size >= 3
    assert len({x.id for x in got}) == len(got)
    for c, members in groups.items():
        assert c == min(members) and len(members) >= 3
        assert all(s[at[a], at[b]] >= 0.85 for a in members for b in members if a != b)
    # components that are mutually similar must come out whole
    seen, whole = set(), []
    for i in range(len(ids)):
        if i not in seen:
            todo, part = [i], []
            seen.add(i)
            while todo:
                a = todo.pop()
                part.append(a)
                for b in np.flatnonzero(s[a] >= 0.85):
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            if len(part) >= 3 and all(s[a, b] >= 0.85 for a in part for b in part if a != b):
                whole.append(sorted(ids[a] for a in part))
    assert whole and all(sorted(groups.get(w[0], [])) == w for w in whole)
    assert similarity_clusters(df.where("false"), "user", "id", "vec", dim=DIM).count() == 0


def test_centroids_are_numbered_alike():
    """Whatever order a shuffle gives the centroids in, a row gets the same label, also from another part of its group."""
    rng = np.random.default_rng(5)
    total, n = rng.standard_normal((50, DIM)) * 4, rng.integers(3, 9, 50).astype(float)
    x = total[np.arange(300) % 50] + 0.1 * rng.standard_normal((300, DIM))
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = []
    for seed in range(3):
        at = np.random.default_rng(seed).permutation(50)
        table = pa.table({"_w": pa.array(n[at]), "_s": pa.array(total[at].tolist(), pa.list_(pa.float64()))})
        labels.append(clusters.assign(x, clusters._features(table, DIM)[0], 0.85)[0].tolist())
    assert labels[0] == labels[1] == labels[2] and len(set(labels[0])) == 50


def test_leaves_keep_their_similarity(monkeypatch):
    monkeypatch.setattr(clusters, "MAX_LEAVES", 8)
    x = np.eye(DIM)
    assert len(clusters.leaves(x, np.ones(DIM), 0.85)[1]) == DIM


def test_clusters_of_lists_with_many_leaves(spark):
    """Comparing long lists in pairs of blocks gives what whole lists give; features that can join none are dropped."""
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.standard_normal((40, DIM)).repeat(4, 0) + 0.12 * rng.standard_normal((160, DIM)), rng.standard_normal((200, DIM))])
    df = spark.createDataFrame([("a", f"{i:03d}", x.tolist()) for i, x in enumerate(v.astype(np.float32))], "user string, id string, vec array<float>")
    whole, blocks = ({(x.cluster_id, x.id) for x in similarity_clusters(df, "user", "id", "vec", 0.85, 3, DIM, 100, m, 200).collect()} for m in (10_000, 30))
    assert len(whole) > 100 and blocks == whole
    x = v / np.linalg.norm(v, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -1)
    keep = clusters.joinable(x, np.ones(len(x)), np.zeros(len(x)), 0.85, 3)
    assert (keep == (s >= 0.85).any(1)).all() and keep.sum() < 300


def many(n=12_000, dim=64, seed=4):
    """Vectors as they occur: topics, groups of near copies within them, and rows on their own."""
    rng = np.random.default_rng(seed)
    topics = rng.standard_normal((25, dim))
    heads = topics[rng.integers(0, 25, n // 5)] + 0.8 * rng.standard_normal((n // 5, dim))
    x = heads[rng.integers(0, len(heads), n)] + np.where(rng.random(n) < 0.5, 0.3, 1.2)[:, None] * rng.standard_normal((n, dim))
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    x = many()
    path = str(tmp_path_factory.mktemp("vectors") / "v.parquet")
    df = spark.createDataFrame(pa.table({"user": ["a"] * len(x), "id": [f"{i:05d}" for i in range(len(x))], "vec": pa.array(x.tolist(), pa.list_(pa.float32()))}).to_pandas(), "user string, id string, vec array<float>")
    df.repartition(6).write.parquet(path)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    return spark.read.parquet(path), u


@pytest.mark.parametrize("least,probes", [(0.85, 4), (-1.0, 8)])
def test_recall_over_lists(large, least, probes):
    """A group of 12,000 rows in 16 lists: at least 0.95 of the exact neighbours, none wrong, each vector asked of few lists."""
    df, u = large
    want = set()
    for lo in range(0, len(u), 2_000):
        s = u[lo : lo + 2_000] @ u.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -2
        top = np.argpartition(-s, 5, axis=1)[:, :5]
        want |= {(lo + i, int(j)) for i in range(len(s)) for j in top[i] if s[i, j] >= least}
    got = {(int(x.id), int(x.neighbour)) for x in nearest(df, "user", "id", "vec", 5, least, 64, 1_000, 800, probes).collect()}
    assert len(got & want) >= 0.95 * len(want) > 1000 and len(got - want) <= 0.05 * len(got)


def test_most_candidates_are_abandoned_early(large):
    u = large[1]
    for least in (0.85, -1.0):
        neighbours.counted.update(pairs=0, abandoned=0)
        neighbours.scan(u[:400], u, np.arange(400), 5, least)
        assert neighbours.counted["abandoned"] > neighbours.counted["pairs"] / 2


def test_clusters_over_lists(large):
    """The same clusters from one task as from many."""
    df, _ = large
    got = [{(x.cluster_id, x.id) for x in similarity_clusters(df, "user", "id", "vec", group_rows=g, per_list=800, cluster_rows=c).collect()} for g, c in ((100_000, 100_000), (1_000, 100_000), (1_000, 10))]
    assert len(got[0]) > 1000 and all(len(g & got[0]) >= 0.95 * len(got[0]) and len(g & got[0]) >= 0.95 * len(g) for g in got[1:])
