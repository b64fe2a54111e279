"""Near copies among embeddings by NN-descent.

A neighbour graph starts from runs of a forest of random cuts and is refined by joins of
neighbours' neighbours, a node's neighbourhood in one row at a time. Edges above the threshold
are computed again in doubles. A list that is full of such edges is saturated: it is enlarged to
all of its component, by blocks that give counts and not pairs. An audit counts the links of a
sample of nodes against all others; below the wanted recall, further cuts and joins follow.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.blocks import against_all, by_length, column
from claimweave.operators.components import components
from claimweave.operators.tables import written

from .exchange import fanout

#: Neighbours in a list, cuts' bits, rows of a run, rows of a block where lists are enlarged.
NEIGHBOURS, BITS, LEAF, BLOCK = 10, 40, 128, 2048
#: How far a cosine of half-precision vectors may be from that of doubles.
SLACK = 0.01


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow of large components; zero rows stay."""
    x = x / np.maximum(np.abs(x).max(1, initial=0, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, label, v, copies, first, u): the different vectors of each label, u being the unit vector in half precision."""
    real = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    groups = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & real).groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("id").alias("first"))

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u: list = [None] * len(batch)
            for at, x in by_length(batch.column("v")):
                for k, y in zip(at.tolist(), unit(x).astype(np.float16), strict=True):
                    u[k] = y.tobytes()
            yield batch.append_column("u", pa.array(u, pa.binary()))

    schema = groups.withColumn("u", F.lit(b"")).schema
    return written(groups.mapInArrow(halves, schema).withColumn("node", F.monotonically_increasing_id()))


def _cuts(nodes: DataFrame, trees: int, seed: int) -> dict[int, np.ndarray]:
    """For each length of vectors the directions of the cuts, as rows: differences of drawn vectors, which cut where the vectors are."""
    need = 2 * BITS * trees
    drawn = nodes.select("u", F.xxhash64("node", F.lit(seed)).alias("h")).orderBy("h").limit(need).collect()
    by_size: dict[int, list] = {}
    for r in drawn:
        by_size.setdefault(len(r.u) // 2, []).append(np.frombuffer(r.u, np.float16).astype(np.float32))
    out = {}
    for size, x in by_size.items():
        more = np.random.default_rng([seed, size]).normal(size=(BITS * trees, size)).astype(np.float32)
        pairs = np.array(x[: len(x) // 2 * 2]).reshape(-1, 2, size)
        more[: len(pairs)] = pairs[:, 0] - pairs[:, 1]
        out[size] = more
    return out


def _runs(nodes: DataFrame, k: int, trees: int, seed: int) -> DataFrame:
    """(a, b, sim): the nearest k of each node in its run, for each tree. Nodes are sorted by the sides of the cuts on which they lie, and each LEAF in that order are a run."""
    cuts = _cuts(nodes, trees, seed)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list = [None] * len(batch)
            raw = batch.column("u").to_pylist()
            sizes = np.array([len(x) // 2 for x in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.stack([np.frombuffer(raw[i], np.float16) for i in at]).astype(np.float32)
                w = cuts.get(size)
                w = np.random.default_rng([seed, size]).normal(size=(BITS * trees, size)).astype(np.float32) if w is None else w
                side = (x @ w.T > 0).reshape(len(at), trees, BITS) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                for i, c in zip(at.tolist(), side.tolist(), strict=True):
                    codes[i] = c
            yield batch.append_column("codes", pa.array(codes, pa.list_(pa.int64())))

    few = nodes.select("node", "label", "u")
    lines = few.mapInArrow(coded, few.withColumn("codes", F.array(F.lit(0).cast("long"))).schema).select(F.posexplode("codes").alias("tree", "code"), "label", F.length("u").alias("size"), "node", "u")
    order = ["tree", "label", "size", "code", "node"]
    n = max(fanout(nodes), math.ceil(trees * fanout(nodes) / 2))
    lines = lines.withColumn("g", F.xxhash64("tree", "label", "size")).repartitionByRange(n, *order).sortWithinPartitions(*order).select("g", "node", "u")

    def nearest(node: np.ndarray, raw: list) -> pa.RecordBatch:
        x = np.stack([np.frombuffer(y, np.float16) for y in raw]).astype(np.float32)
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        m = min(k, len(x) - 1)
        best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m else np.zeros((len(x), 0), int)
        own = np.repeat(np.arange(len(x)), m)
        return pa.RecordBatch.from_pydict({"a": node[own], "b": node[best.ravel()], "sim": s[own, best.ravel()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, node, raw = None, [], []
        for batch in batches:
            g, ids, us = (batch.column(c).to_pylist() for c in ("g", "node", "u"))
            for a, i, u in zip(g, ids, us, strict=True):
                if a != group or len(node) == LEAF:
                    if len(node) > 1:
                        yield nearest(np.array(node), raw)
                    group, node, raw = a, [], []
                node.append(i)
                raw.append(u)
        if len(node) > 1:
            yield nearest(np.array(node), raw)

    return lines.mapInArrow(run, "a long, b long, sim float").withColumn("new", F.lit(True))


def _first(edges: DataFrame, by: str, k: int) -> DataFrame:
    other = "b" if by == "a" else "a"
    return edges.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sim"), other))).where(F.col("r") <= k).drop("r")


def _merged(edges: DataFrame, k: int) -> DataFrame:
    """The lists of the k nearest, each edge once; one that any earlier list had isn't new."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return written(_first(once, "a", k))


def _joined(nodes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Edges between neighbours of one node, one of them new, that are nearer than the last of the list they'd join."""
    turned = _first(lists, "b", k).select(F.col("b").alias("w"), F.col("a").alias("m"), "new")
    members = lists.select(F.col("a").alias("w"), F.col("b").alias("m"), "new").unionByName(turned).groupBy("w", "m").agg(F.max("new").alias("new"))
    last = lists.groupBy(F.col("a").alias("m")).agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("last"))
    about = nodes.select(F.col("node").alias("m"), "u").join(last, "m", "left").withColumn("last", F.coalesce("last", F.lit(-2.0).cast("float")))
    around = members.join(about, "m").groupBy("w").agg(F.collect_list(F.struct("m", "new", "last", "u")).alias("x")).where(F.exists("x", lambda x: x["new"]))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            ends, flat = lists.offsets.to_numpy(), lists.values
            m, new, last = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("m", "new", "last"))
            raw = flat.field("u")
            out: list[list] = [[], [], []]
            for lo, hi in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                x = np.stack([np.frombuffer(y, np.float16) for y in raw.slice(lo, hi - lo).to_pylist()]).astype(np.float32)
                s = x @ x.T
                i, j = np.nonzero((s > last[lo:hi, None]) & (new[lo:hi, None] | new[None, lo:hi]) & (m[lo:hi, None] != m[None, lo:hi]))
                for held, part in zip(out, (m[lo + i], m[lo + j], s[i, j]), strict=True):
                    held.append(part)
            a, b, s = (np.concatenate(x) if x else np.zeros(0) for x in out)
            if len(a):
                order = np.lexsort((b, a))
                keep = np.ones(len(a), bool)
                keep[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
                keep = order[keep]
                yield pa.RecordBatch.from_pydict({"a": a[keep].astype(np.int64), "b": b[keep].astype(np.int64), "sim": s[keep].astype(np.float32)})

    return around.mapInArrow(pairs, "a long, b long, sim float").withColumn("new", F.lit(True))


def _descended(nodes: DataFrame, lists: DataFrame, k: int, rounds: int, settled: float) -> DataFrame:
    """The lists after joins of neighbours' neighbours, until less than a share ``settled`` of the edges is new, or for so many rounds."""
    for _ in range(rounds):
        lists = _merged(lists.withColumn("new", F.lit(False)).unionByName(_joined(nodes, lists, k)), k)
        fresh, every = lists.agg(F.count_if("new"), F.count("*")).first()
        if fresh <= settled * every:
            break
    return lists


def _linked(nodes: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """(a, b), a before b: the lists' edges of that cosine in doubles and one label."""
    near = lists.where(F.col("sim") >= least - SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda n: nodes.select(F.col("node").alias(n), F.col("label").alias(f"label_{n}"), F.col("v").cast("array<double>").alias(f"v_{n}"))
    both = near.join(side("a"), "a").join(side("b"), "b").where("label_a = label_b AND size(v_a) = size(v_b)").select("a", "b", "v_a", "v_b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for (at, x), (_, y) in zip(by_length(batch.column("v_a")), by_length(batch.column("v_b")), strict=True):
                keep[at] = (unit(x) * unit(y)).sum(1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return written(both.mapInArrow(exact, "a long, b long"))


def _counted(nodes: DataFrame, lists: DataFrame, edges: DataFrame, least: float, k: int) -> DataFrame:
    """(node, part, n): each node with an edge, the smallest node of its component, and the rows it is linked with.

    A node whose whole list is above the threshold may have more links than the list holds.
    Lists of the components with such nodes are enlarged to all of the component: its nodes are
    compared in blocks, and each block gives one count for each node.
    """
    parts = written(components(edges))
    turned = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    full = lists.select("a", "b").join(turned, ["a", "b"], "left_semi").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
    dense = written(parts.join(full.select("node"), "node").select("part").distinct())
    sizes = parts.join(dense, "part", "left_semi").groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    inside = parts.join(sizes, "part").join(nodes.select("node", "v", "copies"), "node").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = inside.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("part", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "node", "copies", F.col("v").cast("array<double>").alias("v"))

    def cell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u = unit(np.stack(pdf.v.to_numpy()))
        node, copies, block = pdf.node.to_numpy(), pdf.copies.to_numpy(float), pdf.b.to_numpy()
        left = np.flatnonzero(block == key[1])
        right = left if key[1] == key[2] else np.flatnonzero(block == key[2])
        near = u[left] @ u[right].T >= least
        if key[1] == key[2]:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"node": node[left], "n": (near @ copies[right]).astype(np.int64)})
        return pd.DataFrame({"node": np.append(node[left], node[right]), "n": np.append(near @ copies[right], copies[left] @ near).astype(np.int64)})

    counted = cells.groupBy("part", "x", "y").applyInPandas(cell, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    open_ = turned.join(parts.withColumnRenamed("node", "a"), "a").join(dense, "part", "left_anti")
    listed = open_.join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("n"))
    return written(parts.join(counted.unionByName(listed), "node"))


def _audited(nodes: DataFrame, found: DataFrame, least: float, sample: int, seed: int) -> float:
    """The share of links found among those that a sample of nodes has with all nodes; 1 if it has none."""
    drawn = nodes.select("node", "label", F.col("v").cast("array<double>").alias("v")).orderBy(F.xxhash64("node", F.lit(seed))).limit(sample)

    def start(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column("node").to_numpy(), "label": np.array(batch.column("label").to_pylist(), object), "by": {x.shape[1]: (at, unit(x)) for at, x in by_length(batch.column("v"))}, "n": np.zeros(len(batch))}

    def step(state: dict, rows: pa.RecordBatch) -> None:
        label, copies, node = np.array(rows.column("label").to_pylist(), object), rows.column("copies").to_numpy().astype(float), rows.column("node").to_numpy()
        for at, x in by_length(rows.column("v")):
            if x.shape[1] in state["by"]:
                own, u = state["by"][x.shape[1]]
                i, j = np.nonzero(u @ unit(x).T >= least)
                i, j = own[i], at[j]
                right = (state["label"][i] == label[j]) & (state["node"][i] != node[j])
                np.add.at(state["n"], i[right], copies[j[right]])

    def finish(state: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": state["node"], "n": state["n"].astype(np.int64)})

    true = against_all(drawn, nodes.select("node", "label", "v", "copies"), start, step, finish, "node long, n long", "node").groupBy("node").agg(F.sum("n").alias("true"))
    both = true.join(found.select("node", F.col("n").alias("found")), "node", "left")
    have, want = both.agg(F.sum(F.least(F.coalesce("found", F.lit(0)), F.col("true"))), F.sum("true")).first()
    return have / want if want else 1.0


def neighbour_links(nodes: DataFrame, least: float, neighbours: int = NEIGHBOURS, trees: int = 4, rounds: int = 4, settled: float = 0.01, sample: int = 1024, recall: float = 0.99, attempts: int = 6) -> tuple[DataFrame, float]:
    """((node, part, n) of the nodes with a link, the audited recall): more cuts and joins follow while the audit finds too little, up to ``attempts`` times."""
    lists = None
    for seed in range(attempts):
        runs = _runs(nodes, neighbours, trees, seed)
        lists = _merged(runs if lists is None else lists.withColumn("new", F.lit(False)).unionByName(runs), neighbours)
        lists = _descended(nodes, lists, neighbours, rounds, settled)
        found = _counted(nodes, lists, _linked(nodes, lists, least), least, neighbours)
        share = _audited(nodes, found, least, sample, seed)
        logging.getLogger(__name__).info("recall %.4f of the links of %d nodes, attempt %d", share, sample, seed + 1)
        if share >= recall:
            break
    return found, share


def embedding_components(vectors: DataFrame, least: float = 0.93, id: str = "vec_id", label: str | Column = "label", embedding: str = "embedding", **options) -> DataFrame:
    """(id, n_links, component_id, kept): how many other vectors a vector is linked with, and the smallest id it reaches by links.

    Two rows link if their labels are equal and the cosine of their vectors, in doubles, is at
    least ``least``. No link is below it; that few are missed is what the audit checks (options:
    see neighbour_links). Equal vectors of one label are one node and all linked.

    Rows with a null id or label, and those whose vector is null, empty or zero or holds a null
    or non-finite component, link with nothing: no links, their own id as component, kept (a row
    without an id has no component). Vectors of different lengths don't link. Of rows that share
    an id each counts for itself.
    """
    v = column(embedding)
    kind = vectors.schema[embedding].dataType.simpleString()
    rows = vectors.select(column(id).alias("id"), column(label).alias("label") if isinstance(label, str) else label.alias("label"), (v if kind in ("array<float>", "array<double>") else v.cast("array<double>")).alias("v"))
    nodes = _nodes(rows)
    found, _ = neighbour_links(nodes, least, **options)
    smallest = found.join(nodes.select("node", "first"), "node").groupBy("part").agg(F.min("first").alias("component_id"))
    ends = nodes.join(found, "node", "left").join(smallest, "part", "left").select("label", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    # rows without an id have no node
    joined = rows.withColumn("label", F.when(F.col("id").isNotNull(), F.col("label"))).join(ends, ["label", "v"], "left")
    out = joined.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", column(id).eqNullSafe(F.col("component_id")))
