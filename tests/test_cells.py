"""Clusters and near-duplicates of groups that no task takes whole, against those of one task."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from chronolake.operators import cells, cluster, vector

T0 = datetime(2026, 6, 1)
SCHEMA = "id string, timestamp timestamp, project string, embedding array<float>"


def rows_of(spark, vs, project=lambda i: None):
    rows = [(f"e{i:04}", T0 + timedelta(minutes=i // 2), project(i), None if v is None else [float(x) for x in np.asarray(v, np.float32)]) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)


def blobs(n, dim, noise, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(1, n // 25), dim))
    at = rng.integers(0, len(base), n)
    return base[at] + noise * rng.normal(size=(n, dim))


def clusters(df):
    return sorted((r.id, r.cluster) for r in df.collect())


@pytest.mark.parametrize(("dim", "noise", "block"), [(8, 0.15, 40), (8, 0.02, 1000), (2, 0.3, 60), (32, 0.2, 40)])
def test_clusters_of_one_large_group(spark, dim, noise, block):
    e = rows_of(spark, blobs(300, dim, noise))
    whole = cluster.dbscan(e, [], 0.7, 3)
    got = clusters(cluster.spread_dbscan(e, [], 0.3, 3, block))
    assert got == clusters(whole) and len({c for _, c in got}) > (dim > 2) * 2


def test_clusters_by_group(spark):
    e = rows_of(spark, blobs(260, 6, 0.1), lambda i: None if i % 5 == 0 else f"p{i % 3}")
    want = clusters(cluster.dbscan(e, ["project"], 0.7, 2))
    assert clusters(cluster.dbscan(e, ["project"], 0.7, 2, block=30)) == want
    assert clusters(cluster.dbscan(e, ["project"], 0.7, 2, block=60)) == want  # some groups are small, some large


def test_a_hot_cell_is_cut_in_blocks(spark):
    """Nearly equal vectors lie in one cell: no group takes more than two blocks."""
    rng = np.random.default_rng(3)
    e = rows_of(spark, np.concatenate([np.ones((200, 8)) + 0.001 * rng.normal(size=(200, 8)), rng.normal(size=(60, 8))]))
    met = cells.cells(cluster.as_rows(e, [])[1], 0.3, 25)
    sizes = [r["count"] for r in met.groupBy(*cells.GROUP).count().collect()]
    assert max(sizes) < 4 * 25 and len(sizes) > 30
    assert clusters(cluster.spread_dbscan(e, [], 0.3, 3, 25)) == clusters(cluster.dbscan(e, [], 0.7, 3))


def test_equal_and_empty_vectors(spark):
    e = rows_of(spark, [[1, 0]] * 30 + [[0, 0]] * 6 + [[0, 1]] * 5 + [None] * 3)
    assert clusters(cluster.spread_dbscan(e.filter("embedding is not null"), [], 0.3, 3, 8)) == clusters(cluster.dbscan(e, [], 0.7, 3))
    want = sorted(r.id for r in vector.greedy_dedup(e, [], 0.9, least=2).collect())
    assert sorted(r.id for r in vector.spread_dedup(e, [], 0.9, 8).collect()) == want and len(want) == 1 + 6 + 1 + 3


def chain(n):
    """Each vector resembles the one before and after it, and no other: what stays is every second one."""
    angle = np.arange(n) * 0.2
    return np.stack([np.cos(angle), np.sin(angle), 0.02 * np.arange(n)], 1)


@pytest.mark.parametrize("block", [12, 40, 1000])
def test_what_stays_is_what_one_scan_keeps(spark, block):
    for vs, threshold in ((blobs(240, 8, 0.2), 0.9), (chain(60), 0.985), (np.random.default_rng(2).normal(size=(150, 3)), 0.8)):
        e = rows_of(spark, vs)
        want = sorted(r.id for r in vector.greedy_dedup(e, [], threshold, least=2).collect())
        got = vector.spread_dedup(e, [], threshold, block)
        assert sorted(r.id for r in got.collect()) == want and got.columns == e.columns and 1 < len(want) < len(vs)


def test_large_groups_beside_small_ones(spark):
    e = rows_of(spark, blobs(200, 6, 0.1), lambda i: None if i % 4 else f"p{i % 8}")
    want = sorted(r.id for r in vector.greedy_dedup(e, ["project"], 0.9, least=30).collect())
    got = vector.greedy_dedup(e, ["project"], 0.9, least=30, block=40)
    assert sorted(r.id for r in got.collect()) == want
    with pytest.raises(ValueError, match="above 0"):
        vector.spread_dedup(e, [], 0)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 240)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.label for r in cells.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert cells.components(spark.createDataFrame([], "u long, v long")).count() == 0
