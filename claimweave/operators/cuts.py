"""Near vectors by a forest of random cuts: rows sorted by the sides of cuts on which they lie, and compared within runs of that order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.blocks import by_length

#: Cuts of a tree: their sides are the bits of a code.
BITS = 40


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow of large components; zero rows stay."""
    x = x / np.maximum(np.abs(x).max(1, initial=0, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def whole(v: Column) -> Column:
    """Whether an array holds finite numbers only; null for null."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def finite(v: Column) -> Column:
    """Whether an array holds finite numbers only, one of them not 0; null for null."""
    return whole(v) & F.exists(v, lambda x: x != 0)


def _directions(rows: DataFrame, trees: int, seed: int) -> dict[int, np.ndarray]:
    """For each length of vectors the directions of the cuts, as rows: differences of drawn unit vectors, which cut where the vectors are."""
    drawn = rows.select("u", F.xxhash64("node", F.lit(seed)).alias("h")).orderBy("h").limit(2 * BITS * trees).collect()
    by_size: dict[int, list] = {}
    for r in drawn:
        by_size.setdefault(len(r.u) // 2, []).append(np.frombuffer(r.u, np.float16).astype(np.float32))
    out = {}
    for size, x in by_size.items():
        out[size] = _any_directions(size, trees, seed)
        pairs = np.array(x[: len(x) // 2 * 2]).reshape(-1, 2, size)
        out[size][: len(pairs)] = pairs[:, 0] - pairs[:, 1]
    return out


def _any_directions(size: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).normal(size=(BITS * trees, size)).astype(np.float32)


def halves(rows: DataFrame, v: str = "v") -> DataFrame:
    """rows with u, the unit vector of each vector in half precision, as bytes; vectors have to be finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u: list = [None] * len(batch)
            for at, x in by_length(batch.column(v)):
                for k, y in zip(at.tolist(), unit(x).astype(np.float16), strict=True):
                    u[k] = y.tobytes()
            yield batch.append_column("u", pa.array(u, pa.binary()))

    return rows.mapInArrow(run, rows.withColumn("u", F.lit(b"")).schema)


def matrix(raw: list[bytes]) -> np.ndarray:
    """Single-precision rows of vectors as ``halves`` writes them."""
    return np.stack([np.frombuffer(x, np.float16) for x in raw]).astype(np.float32)


def neighbours_in_runs(rows: DataFrame, k: int, trees: int, leaf: int, n: int, seed: int = 0, within: str | None = None) -> DataFrame:
    """(a, b, sim): the nearest k by cosine of each node in its runs, a run for each tree.

    rows has node and u (see ``halves``), and rows only meet others of one value of the column
    ``within``, if given, and of one length. Each ``leaf`` rows in a tree's order are a run, so a
    task holds no more however the vectors lie. n: partitions of the sort.
    """
    cuts = _directions(rows, trees, seed)
    kind = rows.schema["node"].dataType

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list = [None] * len(batch)
            raw = batch.column("u").to_pylist()
            sizes = np.array([len(x) // 2 for x in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                w = cuts.get(size)
                w = _any_directions(size, trees, seed) if w is None else w
                side = (matrix([raw[i] for i in at]) @ w.T > 0).reshape(len(at), trees, BITS) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                for i, c in zip(at.tolist(), side.tolist(), strict=True):
                    codes[i] = c
            yield batch.append_column("codes", pa.array(codes, pa.list_(pa.int64())))

    few = rows.select("node", (F.col(within) if within else F.lit(0)).alias("within"), "u")
    lines = few.mapInArrow(coded, few.withColumn("codes", F.array(F.lit(0).cast("long"))).schema).select(F.posexplode("codes").alias("tree", "code"), "within", F.length("u").alias("size"), "node", "u")
    order = ["tree", "within", "size", "code", "node"]
    lines = lines.withColumn("g", F.xxhash64("tree", "within", "size")).repartitionByRange(n, *order).sortWithinPartitions(*order).select("g", "node", "u")

    def nearest(node: list, raw: list) -> pa.RecordBatch:
        x = matrix(raw)
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        m = min(k, len(x) - 1)
        best = np.argpartition(-s, m - 1, axis=1)[:, :m]
        own = np.repeat(np.arange(len(x)), m)
        names = pa.array(node)
        return pa.RecordBatch.from_pydict({"a": names.take(pa.array(own)), "b": names.take(pa.array(best.ravel())), "sim": s[own, best.ravel()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, node, raw = None, [], []
        for batch in batches:
            for g, i, u in zip(*(batch.column(c).to_pylist() for c in ("g", "node", "u")), strict=True):
                if g != group or len(node) == leaf:
                    if len(node) > 1:
                        yield nearest(node, raw)
                    group, node, raw = g, [], []
                node.append(i)
                raw.append(u)
        if len(node) > 1:
            yield nearest(node, raw)

    return lines.mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}, sim float")


def partitions(spark, rows: int, bytes_each: int) -> int:
    """Partitions for so many rows: the session's number, or more if each would exceed 8 MB."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * bytes_each / (8 << 20)))
