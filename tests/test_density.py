"""HDBSCAN over a table against a sweep of all pairs in their order, which knows no tree."""

import numpy as np
import pytest

from claimweave.operators import density as D
from claimweave.operators import pairs as P


def table(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<double>")


def distances(x):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.round(np.clip(1 - u @ u.T, 0, 2), 12)


def reachability(x, samples):
    d = distances(x)
    if samples == 1:
        return d
    near = np.sort(np.where(np.eye(len(d), dtype=bool), np.inf, np.round(d, 9)), axis=1)[:, min(samples, len(d) - 1) - 1]
    return np.maximum(d, np.maximum(near[:, None], near[None, :]))


def sweep(d, least):
    """Labels: sets of rows joined pair by pair, then clusters followed down from the whole."""
    n, made, of = len(d), {}, {}
    for i in range(n):
        of[i] = frozenset([i])
    for w, i, j in sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        if of[i] != of[j]:
            both = of[i] | of[j]
            made[both] = (1 / max(w, 1e-12), of[i], of[j])
            for k in both:
                of[k] = both

    def best(rows, birth):
        """(weight, sets chosen) within a cluster that begins as rows."""
        now, mass = rows, 0.0
        while True:
            density, a, b = made[now]
            big = [s for s in (a, b) if len(s) >= least]
            if len(big) == 1:
                mass += (len(now) - len(big[0])) * density
                now = big[0]
                continue
            own = mass + len(now) * density - birth * len(rows)
            below = [best(s, density) for s in big]
            if below and (sum(w for w, _ in below) > own or birth == 0.0):
                return sum(w for w, _ in below), [s for _, c in below for s in c]
            return own, ([rows] if birth else [])

    labels = np.full(n, -1)
    if n >= least:
        for k, rows in enumerate(sorted(best(frozenset(range(n)), 0.0)[1], key=min)):
            labels[list(rows)] = k
    return labels.tolist()


def clouds(seed, lone=12):
    rng = np.random.default_rng(seed)
    x = [rng.normal(c, s, (k, 4)) for c, s, k in (([3, 0, 0, 0], 0.1, 14), ([3, 1, 0, 0], 0.1, 9), ([0, 3, 0, 0], 0.5, 11), ([0, 0, 3, 3], 0.05, 6))]
    return np.concatenate([*x, rng.normal(size=(lone, 4))])[rng.permutation(40 + lone)]


@pytest.mark.parametrize(("least", "samples", "run"), [(2, 1, 1000), (5, 3, 20), (2, 1, 14)])
def test_equals_the_sweep(spark, least, samples, run, monkeypatch):
    monkeypatch.setattr(D, "RUN", run)
    x = clouds(least + samples)
    got = [r.label for r in D.hdbscan_all(table(spark, x), min_cluster_size=least, min_samples=samples).orderBy("id").collect()]
    assert got == sweep(reachability(x, samples), least) and len(set(got)) > 2


def test_copies_and_rows_without_vectors(spark, monkeypatch):
    """A third of the rows are copies, so their distances are ties; rows without a vector are noise."""
    monkeypatch.setattr(D, "RUN", 15)
    x = clouds(3)[:30]
    x[::3] = x[0] * 2.0 ** np.arange(10)[:, None]  # the same direction, without rounding
    got = [r.label for r in D.hdbscan_all(table(spark, [*x, None, []]), min_cluster_size=3).orderBy("id").collect()]
    assert got == [*sweep(distances(x), 3), -1, -1] and len({got[i] for i in range(0, 30, 3)}) == 1


def test_core_distances(spark):
    x = clouds(1)
    d = np.sort(distances(x) + np.where(np.eye(len(x), dtype=bool), 9, 0), axis=1)
    for k in (1, 4):
        got = {r.id: r.core for r in D.core_distances(table(spark, x), k).collect()}
        assert np.allclose([got[i] for i in range(len(x))], d[:, k - 1], atol=2e-9)


def test_small_tables(spark):
    one = table(spark, [[1.0, 2.0]])
    assert [tuple(r) for r in D.hdbscan_all(one).collect()] == [(0, -1)]
    assert D.hdbscan_all(one.limit(0)).collect() == []
    assert {r.label for r in D.hdbscan_all(table(spark, [[1.0, 2.0], [2.0, 1.0]])).collect()} == {-1}
    with pytest.raises(ValueError, match="two rows"):
        D.hdbscan_all(one, min_cluster_size=1)


def test_a_task_holds_a_run_only(spark, monkeypatch):
    """No task merges more edges than a run, nor is told of more parts than their ends."""
    monkeypatch.setattr(D, "RUN", 26)
    own = D._runs
    seen = []
    monkeypatch.setattr(D, "_runs", lambda tree: seen.append(own(tree)) or seen[-1])
    tree = D.reachability_tree(table(spark, clouds(5)))
    D.tree_labels(tree).collect()
    edges, runs = seen[0]
    assert runs == 2 and max(r["count"] for r in edges.groupBy("run").count().collect()) <= 26
    sizes = {}
    for r in edges.orderBy("k").collect():  # the sizes and names of the parts are those of a union in order
        for name, size in ((r.a, r.sa), (r.b, r.sb)):
            assert sizes.get((r.run, name), size) == size
            sizes[r.run, name] = size


@pytest.mark.parametrize(("near", "samples"), [(1, 1), (3, 1), (3, 2), (16, 3), (100, 1)])
def test_trees_by_lists_of_any_length(spark, near, samples, monkeypatch):
    """Groups larger than the lists, copies and zero vectors among them: the tree is that of all pairs in the order of distance and ids."""
    monkeypatch.setattr(P, "NEAR", near)
    x = np.concatenate([clouds(6), np.repeat(clouds(6)[:1], 6, 0), np.zeros((2, 4))])
    d = reachability(x, samples)
    part, want = list(range(len(x))), []
    for w, i, j in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
        if part[i] != part[j]:
            want.append((i, j))
            part = [part[i] if p == part[j] else p for p in part]
    got = D.reachability_tree(table(spark, x), samples).collect()
    assert len(got) == len(want) and np.isclose(sum(r.d for r in got), sum(d[i, j] for i, j in want), atol=1e-8)
    if samples == 1:
        assert sorted((r.i, r.j) for r in got) == sorted(want)


def test_rounds_by_lists_go_through_no_cells(spark, monkeypatch):
    """Where lists tell all parts' nearest edges no round multiplies all pairs."""
    runs, own = [], P._cells
    monkeypatch.setattr(P, "_cells", lambda *a, **b: runs.append(1) or own(*a, **b))
    assert D.reachability_tree(table(spark, np.random.default_rng(1).normal(size=(200, 8)))).count() == 199
    assert len(runs) == 1


def test_groups_without_a_matrix(spark):
    """A group of 4,000 rows stays far below its matrix of 128 MB; labels are those of the matrix."""
    import tracemalloc

    x = np.random.default_rng(2).normal(size=(4000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    got = P._labels_by_rows(len(x), lambda j: np.clip(1 - x @ x[j], 0, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    few = clouds(8)
    few /= np.linalg.norm(few, axis=1, keepdims=True)
    assert P._labels_by_rows(len(few), lambda j: np.clip(1 - few @ few[j], 0, 2), 3).tolist() == sweep(distances(few), 3)
    assert len(set(got.tolist())) > 2
