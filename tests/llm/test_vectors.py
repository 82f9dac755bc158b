"""The bounds of the metric join: they keep every link, and prune."""

import time
import tracemalloc

import numpy as np
import pytest

from spanforge.llm import vectors


def clustered(n, size, clusters, spread, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(clusters, size))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize(("size", "clusters"), [(2, 5), (16, 8), (64, 400), (300, 3)])
def test_heads_bound_products(size, clusters):
    x = clustered(300, size, clusters, 0.3)
    h = vectors.headed(x)
    assert (h @ h.T >= x @ x.T - 1e-12).all()


def test_cells_in_reach_hold_every_link():
    x = clustered(2000, 24, 40, 0.05)
    raw = [v.tobytes() for v in x]
    pivots = vectors.Pivots([{"size": 24, "vector": r} for r in raw[:30]], float(np.sqrt(0.1)))
    home, distance = pivots.home(24, x)
    low = np.array([distance[home == q].min(0) if (home == q).any() else np.full(30, np.inf) for q in range(30)])
    high = np.array([distance[home == q].max(0) if (home == q).any() else np.full(30, -np.inf) for q in range(30)])
    wide = pivots.reach(24, home, distance).sum()
    pivots.rings[24] = low, high
    reach = pivots.reach(24, home, distance)
    i, j = np.nonzero(x @ x.T >= 0.95)
    assert len(i) > 3000 and reach[i, home[j]].all()
    assert reach.sum() < 0.3 * reach.size and reach.sum() <= wide


def test_equal_and_nearly_equal_vectors_are_within_the_slack():
    x = clustered(500, 64, 500, 0)
    y = np.nextafter(x, 1)
    y /= np.linalg.norm(y, axis=1)[:, None]
    assert np.sqrt(np.maximum(0, 2 - 2 * (x * y).sum(1))).max() <= vectors.slack(64)


def test_few_pairs_are_multiplied_as_a_whole():
    x = clustered(3000, 64, 3000, 50)  # without clusters
    cell = vectors.Cell((64, 0, 0), 0.95)
    cell.hosts.append((np.arange(3000), np.ones(3000, int), x))
    cell.begin()
    assert cell.compared < 0.05 * 3000 * 3000 / 2 and not cell.n.any()


def test_links_equal_sql(spark):
    """A table with links, against the definition in SQL."""
    duckdb = pytest.importorskip("duckdb")
    x = clustered(600, 16, 90, 0.05, seed=5)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    from spanforge.llm.registry import ORACLE_SQL

    want = sorted(con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({ORACLE_SQL['op7_metric_range_join']})").fetchall())
    got = sorted(tuple(r) for r in vectors.near_duplicates(df).collect())
    assert got == want and sum(n > 0 for _, n, *_ in got) > 400


def linked_blocks(x, copies, guests=0):
    """What a cell says of x, the last `guests` of which pass by: links by number, and components."""
    k = len(x) - guests
    cell = vectors.Cell((x.shape[1], 0, 0), 0.95)
    cell.hosts.append((np.arange(k), copies[:k], x[:k]))
    batches = [*cell.guests(np.arange(k, len(x)), copies[k:], x[k:]), *cell.done()] if guests else [*cell.done()]
    n, parent = np.zeros(len(x), int), list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for number, links, other in (r for b in batches for r in zip(*b.to_pydict().values(), strict=True)):
        n[number] += links
        if other is not None:
            parent[root(number)] = root(other)
    return n, [root(i) for i in range(len(x))]


def test_blocks_equal_brute_force(monkeypatch):
    monkeypatch.setattr(vectors, "STRIDE", 16)
    monkeypatch.setattr(vectors, "TILE", 24)
    rng = np.random.default_rng(9)
    for spread, groups in ((0.02, 1), (0.05, 9), (0.12, 30), (0.3, 3)):
        x = clustered(230, 8, groups, spread, seed=groups)
        copies = rng.integers(1, 4, len(x))
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        for guests in (0, 90):
            seen = near.copy()
            seen[len(x) - guests :, len(x) - guests :] = False  # guests don't meet one another here
            n, roots = linked_blocks(x, copies, guests)
            assert n.tolist() == (seen @ copies).tolist()
            want = np.arange(len(x))
            for _ in range(len(x)):
                want = np.minimum(want, np.where(seen, want, len(x)).min(1))
            assert len(set(zip(want.tolist(), roots, strict=True))) == len(set(roots)) == len(set(want.tolist()))


def test_a_dense_cluster_is_counted_without_its_pairs():
    x = clustered(20_000, 16, 1, 0.01)
    tracemalloc.start()
    began = time.perf_counter()
    n, roots = linked_blocks(x, np.ones(len(x), int))
    assert time.perf_counter() - began < 60 and tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert (n == len(x) - 1).all() and set(roots) == {roots[0]}
