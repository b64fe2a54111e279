"""A stored graph index: vectors are nodes, edges lead to near ones, and searches walk along them in batches.

The graph is built from a forest of random cuts, whose runs are compared in parts of the table
and merged by node, and pruned: an edge goes if another one leads there by a shorter way. A node's
row has the ids of its neighbours and their vectors in a few bits a component, so a step of all
searches is one join, and only the best of each walk are read as whole vectors and ranked exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions.vectors import cosine_distance
from claimweave.operators.blocks import column
from claimweave.operators.cuts import finite, halves, matrix, neighbours_in_runs, partitions
from claimweave.operators.tables import fresh_path, written
from claimweave.operators.vector_table import search_many

#: A component of a unit vector lies in steps of the sample's spread; beyond so many spreads it counts as the last step.
BITS, SPREADS = 4, 3.0


def _codes(u: np.ndarray, spread: float) -> np.ndarray:
    """Unit vectors in BITS bits a component, two components a byte."""
    steps = np.clip(np.floor((u / (SPREADS * spread) + 1) * 2 ** (BITS - 1)), 0, 2**BITS - 1).astype(np.uint8)
    if steps.shape[1] % 2:
        steps = np.pad(steps, ((0, 0), (0, 1)))
    return steps[:, ::2] << BITS | steps[:, 1::2]


def _decoded(raw: list[bytes], size: int, spread: float) -> np.ndarray:
    both = np.stack([np.frombuffer(x, np.uint8) for x in raw])
    steps = np.empty((len(both), 2 * both.shape[1]), np.float32)
    steps[:, ::2], steps[:, 1::2] = both >> BITS, both & (2**BITS - 1)
    return ((steps[:, :size] + 0.5) / 2 ** (BITS - 1) - 1) * (SPREADS * spread)


def _nodes(table: DataFrame, id: str, embedding: str, size: int | None = None) -> DataFrame:
    """(node, v, u) of the rows that can be indexed, one of each id: with an id, and a vector of finite components that aren't all 0, of the index's length."""
    rows = table.select(column(id).alias("node"), column(embedding).cast("array<float>").alias("v")).where(F.col("node").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite(F.col("v")) & (F.lit(True) if size is None else F.size("v") == size))
    return halves(rows.groupBy("node").agg(F.max("v").alias("v")))


def _pruned(candidates: DataFrame, nodes: DataFrame, degree: int, slack: float) -> DataFrame:
    """(a, b, sim): of each node's candidates, from the nearest on, those to which no edge taken before leads by less than the distance over ``slack``; at most degree."""
    kind = nodes.schema["node"].dataType.simpleString()
    listed = candidates.join(nodes.select(F.col("node").alias("b"), "u"), "b").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("sim", "b", "u")), asc=False).alias("x"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": [], "sim": []}
            for a, near in zip(batch.column("a").to_pylist(), batch.column("x").to_pylist(), strict=True):
                x = matrix([n["u"] for n in near])
                far, own = 1 - x @ x.T, 1 - np.array([n["sim"] for n in near])
                taken: list[int] = []
                for k in range(len(near)):
                    if len(taken) < degree and all(slack * far[k, t] > own[k] for t in taken):
                        taken.append(k)
                out["a"] += [a] * len(taken)
                out["b"] += [near[k]["b"] for k in taken]
                out["sim"] += [near[k]["sim"] for k in taken]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("a", batch.schema.field("a").type), ("b", batch.schema.field("a").type), ("sim", pa.float32())]))

    return listed.mapInArrow(prune, f"a {kind}, b {kind}, sim float")


class GraphIndex:
    """An index under a path: ``vectors`` (the table's rows), ``graph`` (node, neighbours with their bits), ``gone`` (deleted ids), ``about``.

    Rows with a null id, and those whose vector is null, empty or zero, holds a null or non-finite
    component or has another length than most, are not indexed: no search finds them. Of rows that
    share an id one is. Inserts append: new nodes are linked with what a search for them finds,
    in both directions, and nothing that was written is written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        self.id, self.embedding, self.size, self.spread, self.degree, self.slack = (about[k] for k in ("id", "embedding", "size", "spread", "degree", "slack"))
        self.vectors, self.graph, self.gone, self.entries = (spark.read.parquet(f"{path}/{x}") for x in ("vectors", "graph", "gone", "entries"))

    @classmethod
    def create(cls, table: DataFrame, path: str | None = None, degree: int = 24, trees: int = 8, leaf: int = 256, slack: float = 1.2, entries: int = 32, id: str = "id", embedding: str = "embedding") -> GraphIndex:
        """Builds and stores the index. entries: nodes from which every search starts, drawn by hash."""
        spark, path = table.sparkSession, path or fresh_path(table.sparkSession)
        sizes = table.where(column(embedding).isNotNull()).groupBy(F.size(column(embedding)).alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
        size = sizes.n if sizes else 1
        nodes = written(_nodes(table, id, embedding, size))
        drawn = nodes.select("u").orderBy(F.xxhash64("node")).limit(1000).collect()
        spread = float(np.sqrt((matrix([r.u for r in drawn]) ** 2).mean())) if drawn else 1.0
        about = json.dumps({"id": id, "embedding": embedding, "size": size, "spread": spread, "degree": degree, "slack": slack})
        n = partitions(spark, nodes.count() * trees, 2 * size + 40)
        found = neighbours_in_runs(nodes, 2 * degree, trees, leaf, n)
        once = found.groupBy("a", "b").agg(F.max("sim").alias("sim"))
        nearest = once.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("r") <= 3 * degree).drop("r")
        edges = written(_pruned(nearest, nodes, degree, slack))
        table.select(*map(column, table.columns)).write.mode("overwrite").parquet(f"{path}/vectors")
        _write_graph(edges, nodes, spread, degree, f"{path}/graph", "overwrite")
        nodes.select("node").limit(0).write.mode("overwrite").parquet(f"{path}/gone")
        _coded(nodes, spread).orderBy(F.xxhash64("node")).limit(entries).select("node", "code").write.mode("overwrite").parquet(f"{path}/entries")
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        return cls(spark, path)

    def drop(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def walks(self, queries: DataFrame, beam: int = 48, rounds: int = 64) -> DataFrame:
        """(q, v, pool, seen): for each query (q, v) the best nodes that its walk has met, nearest first, and the number of nodes met.

        In each round every query opens all nodes among its best ``beam`` that it has not opened,
        by one join with the graph; it ends when it has none, and the whole when no query has.
        """
        kind = self.graph.schema["node"].dataType.simpleString()
        starts = self.entries.agg(F.collect_list(F.struct("node", "code")).alias("met"))  # at most ``entries`` rows
        state = queries.select("q", F.col("v").cast("array<float>").alias("v"), F.array().cast(f"array<struct<d:float,node:{kind},open:boolean>>").alias("pool"), F.array().cast(f"array<{kind}>").alias("seen"))
        state = written(self._step(state.crossJoin(F.broadcast(starts)), beam))
        for _ in range(rounds):
            front = state.select("q", F.explode("pool").alias("p")).where("p.open").select("q", F.col("p.node").alias("node"))
            if front.isEmpty():
                break
            met = front.join(self.graph, "node").select("q", F.explode("near").alias("m")).groupBy("q").agg(F.collect_set("m").alias("met"))
            state = written(self._step(state.join(met, "q", "left"), beam))
        return state

    def _step(self, state: DataFrame, beam: int) -> DataFrame:
        """The state after each query has seen the nodes it met; the best ``beam`` that are new are open."""
        size, spread = self.size, self.spread
        schema = state.drop("met").schema

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pools, seens = [], []
                for v, pool, seen, met in zip(*(batch.column(c).to_pylist() for c in ("v", "pool", "seen", "met")), strict=True):
                    had = set(seen)
                    fresh = {m["node"]: m["code"] for m in met or [] if m["node"] not in had}
                    pool = [{**p, "open": False} for p in pool]
                    if fresh and v is not None and len(v) == size and None not in v:
                        u = np.nan_to_num(np.array(v, np.float32))
                        far = 1 - _decoded(list(fresh.values()), size, spread) @ (u / max(float(np.linalg.norm(u)), 1e-30))
                        pool += [{"d": float(d), "node": n, "open": True} for n, d in zip(fresh, far.tolist(), strict=True)]
                    pools.append(sorted(pool, key=lambda p: (p["d"], p["node"]))[:beam])
                    seens.append(seen + list(fresh))
                out = {"q": batch.column("q"), "v": batch.column("v"), "pool": pa.array(pools, batch.schema.field("pool").type), "seen": pa.array(seens, batch.schema.field("seen").type)}
                yield pa.RecordBatch.from_pydict(out)

        return state.mapInArrow(step, schema)

    def search(self, queries: DataFrame, limit: int = 5, beam: int = 48, read: int = 40, exact: bool = False) -> DataFrame:
        """(q, id, distance): the nearest rows of each query (q, v), ascending by distance to nine places, ties by id; ``read`` whole vectors of each walk are ranked.

        exact: a check follows, in which all rows pass the queries in blocks and those are added
        that a walk has missed within the distance of its last hit.
        """
        best = self.walks(queries, max(beam, read)).select("q", "v", F.explode(F.slice("pool", 1, read)).alias("p")).select("q", "v", F.col("p.node").alias(self.id))
        best = best.join(self.gone.select(F.col("node").alias(self.id)), self.id, "left_anti")
        rows = self.vectors.select(column(self.id).alias(self.id), column(self.embedding).alias("own")).where(F.col("own").isNotNull() & (F.size("own") == self.size))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("distance", 9), self.id))

        def ranked(best: DataFrame) -> DataFrame:
            far = best.join(rows, self.id).withColumn("distance", cosine_distance(F.col("own"), F.col("v"))).groupBy("q", self.id).agg(F.min("distance").alias("distance"))
            return far.withColumn("rank", rank).where(F.col("rank") <= limit).select("q", self.id, "distance")

        if not exact:
            return ranked(best)
        hits = written(ranked(best))
        both = hits.select("q", self.id).unionByName(self._missed(queries, hits, limit))
        return ranked(both.join(queries.select("q", "v"), "q"))

    def _missed(self, queries: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
        """(q, id) of each query's nearest rows that its hits don't have."""
        last = hits.groupBy("q").agg(F.when(F.count("*") >= limit, F.max("distance") + 1e-9).alias("bound"))  # rounding may set equal distances apart
        asked = queries.join(last, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(2.0)))
        left = self.vectors.where(finite(column(self.embedding)) & (F.size(column(self.embedding)) == self.size))
        left = left.join(self.gone.select(F.col("node").alias(self.id)).distinct(), self.id, "left_anti")
        near = search_many(left, asked, limit, self.id, self.embedding, within="bound")
        return near.select("q", self.id).distinct().join(hits.select("q", self.id), ["q", self.id], "left_anti")

    def insert(self, rows: DataFrame, beam: int = 48) -> GraphIndex:
        """The index with further rows, whose ids must be new to it."""
        nodes = written(_nodes(rows, self.id, self.embedding, self.size))
        walked = self.walks(nodes.select(F.col("node").alias("q"), "v"), beam).select(F.col("q").alias("a"), F.explode("pool").alias("p")).select("a", F.col("p.node").alias("b"), (1 - F.col("p.d")).cast("float").alias("sim"))
        n = partitions(self.spark, nodes.count() * 4, 2 * self.size + 40)
        among = neighbours_in_runs(nodes, self.degree, 4, 256, n).groupBy("a", "b").agg(F.max("sim").alias("sim"))
        known = _nodes(self.vectors.join(walked.select(F.col("b").alias(self.id)).distinct(), self.id, "left_semi"), self.id, self.embedding, self.size)
        every = written(nodes.select("node", "v", "u").unionByName(known))
        edges = written(_pruned(walked.unionByName(among).where("a <> b"), every, self.degree, self.slack))
        rows.select(*map(column, self.vectors.columns)).write.mode("append").parquet(f"{self.path}/vectors")
        _write_graph(edges, every, self.spread, self.degree, f"{self.path}/graph", "append")
        return type(self)(self.spark, self.path)

    def delete(self, ids: DataFrame) -> GraphIndex:
        """The index without the rows of these ids: walks still pass them, results don't have them."""
        ids.select(column(self.id).cast(self.gone.schema["node"].dataType).alias("node")).write.mode("append").parquet(f"{self.path}/gone")
        return type(self)(self.spark, self.path)


def _coded(nodes: DataFrame, spread: float) -> DataFrame:
    """nodes (node, u) with code, the bits of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("u").to_pylist()
            codes = [c.tobytes() for c in _codes(matrix(raw), spread)] if raw else []
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "code": pa.array(codes, pa.binary())})

    few = nodes.select("node", "u")
    return few.mapInArrow(run, few.select("node", F.lit(b"").alias("code")).schema)


def _write_graph(edges: DataFrame, nodes: DataFrame, spread: float, degree: int, path: str, mode: str) -> None:
    """Rows (node, near): edges in both directions, of those that come in the nearest ``degree``; a node may have several rows."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim").withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("r") <= degree).drop("r")
    both = edges.unionByName(back).select("a", "b").distinct()
    near = both.join(_coded(nodes, spread).select(F.col("node").alias("b"), "code"), "b")
    near.groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct(F.col("b").alias("node"), "code")).alias("near")).write.mode(mode).parquet(path)
