"""Searches of many queries, and the stored indexes, against brute force; vectors that are null, empty or zero."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimweave.operators import vector_table as V
from claimweave.operators.blocks import against_all
from claimweave.operators.graph_index import GraphIndex


def table(spark, x, first=0):
    rows = [(first + i, None if v is None else [float(c) if c is not None else None for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def clustered(n=600, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    return centres[np.arange(n) % 12] + 0.4 * rng.normal(size=(n, 24))


ODD = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0]]


def nearest(x, q, k, skip=()):
    x = np.asarray(x, np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = np.round(1 - u @ u[q], 9)
    return [i for i in np.lexsort((np.arange(len(x)), far)).tolist() if i not in skip][:k]


def by_query(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.q, []).append((r.distance, r.id))
    return {q: [i for _, i in sorted(x)] for q, x in out.items()}


@pytest.fixture(params=["clustered", "not"])
def vectors(request):
    return clustered() if request.param == "clustered" else np.random.default_rng(1).normal(size=(600, 24))


def asked(df, every=20):
    return df.where(F.col("id") % every == 0).select(F.col("id").alias("q"), F.col("embedding").alias("v"))


def test_search_many(spark, vectors, monkeypatch):
    own = V.against_all
    df = table(spark, [*vectors, *ODD])
    want = {q: nearest(vectors, q, 10) for q in range(0, 600, 20)}
    for each in ((1 << 15, 1 << 20), (7, 50)):
        monkeypatch.setattr(V, "against_all", lambda *a, e=each: own(*a, queries_each=e[0], rows_each=e[1]))
        got = by_query(V.search_many(df, asked(df), 10))
        assert {q: got[q] for q in want} == want
    assert by_query(V.search_many(df.limit(0), asked(df), 10)) == {} == by_query(V.search_many(df, asked(df.limit(0)), 10))


def test_a_task_keeps_k_rows_of_a_query(spark):
    """What leaves the tasks is bounded by queries, k and stripes, not by rows."""
    sizes = []
    df = table(spark, clustered(1200))

    def watched(*a, **b):
        found = against_all(*a, **b)
        sizes.append(found.count())
        return found

    own, V.against_all = V.against_all, watched
    try:
        V.search_many(df, asked(df, 100), 3).count()
    finally:
        V.against_all = own
    assert sizes[0] <= 12 * 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_search_without_vectors(spark):
    df = table(spark, [[1.0, 0.0], None, [None, 1.0], [float("nan"), 1.0], [0.0, 0.0], [0.0, 1.0]])
    assert [(r.id, round(r.distance, 6)) for r in V.search(df, [1.0, 0.0], 9).collect()] == [(0, 0.0), (4, 1.0), (5, 1.0)]


def test_graph_index(spark, vectors, tmp_path):
    df = table(spark, [*vectors, *ODD])
    index = GraphIndex.create(df, str(tmp_path / "index"), degree=16)
    want = {q: nearest(vectors, q, 10) for q in range(0, 600, 20)}
    again = GraphIndex(spark, str(tmp_path / "index"))  # it is stored
    got = by_query(again.search(asked(df), 10, read=60))
    assert np.mean([len(set(want[q]) & set(got[q])) / 10 for q in want]) >= 0.9
    assert set(got) == set(want)  # queries without a vector find nothing
    assert max(len(r.pool) for r in index.walks(asked(df), 60).collect()) <= 60  # a tenth of the vectors is read
    index.drop()
    assert not (tmp_path / "index").exists()


def test_graph_index_grows(spark, vectors, tmp_path):
    path = tmp_path / "index"
    df = table(spark, vectors)
    index = GraphIndex.create(df.where("id < 400"), str(path), degree=16)
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    index = index.insert(df.where("id >= 400").unionByName(table(spark, ODD, 1000)))
    assert all(f.exists() and f.stat().st_mtime_ns == t for f, t in before.items())  # nothing is rebuilt
    want = {q: nearest(vectors, q, 10) for q in range(0, 600, 20)}
    got = by_query(index.search(asked(df), 10, read=60))
    assert np.mean([len(set(want[q]) & set(got[q])) / 10 for q in want]) >= 0.9
    gone = {q: nearest(vectors, q, 1)[0] for q in want}
    index = index.delete(spark.createDataFrame([(i,) for i in gone.values()], "id long"))
    got = by_query(index.search(asked(df), 10, read=60))
    want = {q: nearest(vectors, q, 10, set(gone.values())) for q in want}
    assert not {i for x in got.values() for i in x} & set(gone.values())
    assert np.mean([len(set(want[q]) & set(got[q])) / 10 for q in want]) >= 0.9


def test_graph_index_checked(spark, vectors):
    """Walks too narrow to find all, among near copies too: the check adds what they missed, and only that."""
    x = np.concatenate([vectors, vectors[:40].repeat(6, 0) + 1e-3 * np.random.default_rng(2).normal(size=(240, 24)), vectors[:1].repeat(30, 0)])
    df = table(spark, [*x, *ODD])
    index = GraphIndex.create(df.where("id % 2 = 0"), degree=4, trees=1, leaf=16, entries=2).insert(df.where("id % 2 = 1"), beam=8)
    index = index.delete(df.where("id % 7 = 3").select("id"))
    want = {q: nearest(x, q, 10, set(range(3, len(x), 7))) for q in range(0, len(x), 20) if q != 880}
    loose = by_query(index.search(asked(df), 10, beam=10, read=10))
    assert any(loose[q] != want[q] for q in want)
    got = by_query(index.search(asked(df), 10, beam=10, read=10, exact=True))
    assert {q: got[q] for q in want} == want


def test_graph_index_of_few_rows(spark):
    assert by_query(GraphIndex.create(table(spark, [[1.0, 0.0], [1.0, 0.1], None])).search(asked(table(spark, [[1.0, 0.0]])), 3)) == {0: [0, 1]}
    assert by_query(GraphIndex.create(table(spark, [None, []])).search(asked(table(spark, [[1.0, 0.0]])), 3)) == {}


def test_inverted_file_of_many(spark, vectors):
    df = table(spark, [*vectors, *ODD])
    index = V.InvertedFile.create(df)
    want = {q: nearest(vectors, q, 10) for q in range(0, 600, 20)}
    got = by_query(index.search_many(asked(df), 10))
    assert np.mean([len(set(want[q]) & set(got[q])) / 10 for q in want]) >= 0.9
    assert {q: by_query(index.search_many(asked(df), 10, probes=16))[q] for q in (0, 20)} == {q: want[q] for q in (0, 20)}
    with pytest.raises(ValueError, match="no vectors"):
        V.InvertedFile.create(table(spark, [None]))


def test_search_many_holds_a_bounded_tile(spark, monkeypatch):
    """The memory of a step doesn't follow queries times rows."""
    tasks = {}

    class Caught(Exception):
        pass

    def caught(queries, rows, start, step, finish, *rest):
        tasks.update(start=start, step=step, finish=finish)
        raise Caught

    monkeypatch.setattr(V, "against_all", caught)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2000, 8)), rng.normal(size=(4000, 8))
    with pytest.raises(Caught):
        V.search_many(table(spark, y[:2]), table(spark, x[:2]).select(F.col("id").alias("q"), F.col("embedding").alias("v")), 3)
    batch = lambda name, v: pa.RecordBatch.from_pydict({name: pa.array(range(len(v)), pa.int64()), "v": pa.array(v.tolist(), pa.list_(pa.float64()))})
    state, rows = tasks["start"](batch("q", x)), batch("id", y)
    tracemalloc.start()
    tasks["step"](state, rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6, most
    u, w = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    want = np.argsort(np.round(np.clip(1 - u @ w.T, 0, 2), 9), axis=1, kind="stable")[:, :3]
    assert np.array_equal(tasks["finish"](state).column("id").to_numpy().reshape(-1, 3), want)
