"""HDBSCAN over a table, without a task that holds the tree.

The least spanning tree's edges, in their order, are cut into runs of ``RUN``. What the edges
before a run have joined is one node of it, so a task merges a run knowing only the state of the
parts that its edges touch: their size, their cluster's mass, and their rows while they are
fewer than a cluster. Runs follow each other, and each passes its parts' states to the run that
needs them next.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.components import components
from claimweave.operators.numbering import numbered
from claimweave.operators.pairs import nearest_others, spanning_tree
from claimweave.operators.tables import fresh_path, written

#: Edges of the tree that one task merges.
RUN = 1_000_000


def core_distances(vectors: DataFrame, min_samples: int, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, core): the distance to the ``min_samples``-th nearest other row, to nine places; to the last one where there are fewer.

    Rows whose vector is null or empty or holds a null or non-finite component have none.
    """
    near = nearest_others(vectors, min_samples, -2.0, id, embedding)
    return near.groupBy(F.col("src").alias(id)).agg(F.round(1 - F.min("score"), 9).alias("core"))


def reachability_tree(vectors: DataFrame, min_samples: int = 1, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(d, i, j): the least spanning tree by mutual reachability, the largest of a pair's distance and its rows' core distances; for one sample that is the distance."""
    core = written(core_distances(vectors, min_samples, id, embedding)) if min_samples > 1 else None
    return spanning_tree(vectors, id, embedding, core=core)


def _runs(tree: DataFrame) -> tuple[DataFrame, int]:
    """(k, d, run, a, sa, b, sb) of the edges in their order, and the number of runs: a and b are the smallest rows of the parts that the edges of all earlier runs have made of an edge's ends, sa and sb their sizes.

    All runs are halved at once, level by level: the parts of each light half become nodes of
    the heavy half beside it. So the levels grow with the logarithm of the runs.
    """
    edges = numbered(tree, ["d", "i", "j"], "k").select("k", "d", (F.col("k") / RUN).cast("int").alias("run"), F.col("i").alias("a"), F.lit(1).cast("long").alias("sa"), F.col("j").alias("b"), F.lit(1).cast("long").alias("sb"))
    edges = written(edges)
    runs = math.ceil(edges.count() / RUN)
    for level in range(math.ceil(math.log2(max(1, runs))) - 1, -1, -1):
        heavy = F.shiftright("run", level).bitwiseAND(F.lit(1)) == 1
        both = F.shiftright("run", level + 1)
        light = edges.where(~heavy).withColumn("s", both)
        ends = light.select(F.struct("s", F.col("a").alias("n")).alias("node"), F.col("sa").alias("size")).unionByName(light.select(F.struct("s", F.col("b").alias("n")).alias("node"), F.col("sb").alias("size"))).distinct()
        parts = components(light.select(F.struct("s", F.col("a").alias("n")).alias("a"), F.struct("s", F.col("b").alias("n")).alias("b")))
        sizes = ends.join(parts, "node").groupBy("part").agg(F.sum("size").alias("size"))
        of = written(parts.join(sizes, "part").select("node.s", "node.n", F.col("part.n").alias("part"), "size"))
        later = edges.where(heavy).withColumn("s", both)
        for end in ("a", "b"):
            side = of.select("s", F.col("n").alias(end), F.col("part").alias("to"), F.col("size").alias("so"))
            later = later.join(side, ["s", end], "left").withColumn(end, F.coalesce("to", end)).withColumn(f"s{end}", F.coalesce("so", f"s{end}")).drop("to", "so")
        edges = written(edges.where(~heavy).unionByName(later.select(*edges.columns)))
    return edges, runs


class _Part:
    """A part of the forest while its run is merged: its rows while they are fewer than a cluster, then its cluster by number, with what has left it, weighed by density, and what its best clusters below weigh."""

    __slots__ = ("size", "rows", "cluster", "mass", "below", "split")

    def __init__(self, size: int, rows: list | None, cluster: int = -1, mass: float = 0.0, below: float = 0.0, split: bool = False):
        self.size, self.rows, self.cluster, self.mass, self.below, self.split = size, rows, cluster, mass, below, split


def _merged(pdf: pd.DataFrame, least: int) -> dict[str, list]:
    """One run's edges merged in order; see ``_OUT`` for what comes out."""
    edges, ends, known = (pdf[pdf.what == w] for w in (0, 1, 2))
    parts = {s.a: _Part(int(s.sa), None if s.cluster >= 0 else s.members.tolist(), int(s.cluster), float(s.mass), float(s.below), bool(s.split)) for s in known.itertuples()}
    after = dict(zip(ends.a.tolist(), ends.sa.tolist(), strict=True))
    above: dict = {}
    out: dict[str, list] = {c: [] for c in ("what", "to", "a", "sa", "cluster", "mass", "below", "split", "members", "parent")}

    def emit(**values: object) -> None:
        for c, x in out.items():
            x.append(values.get(c))

    def find(x: object) -> object:
        while x in above:
            if above[x] in above:
                above[x] = above[above[x]]
            x = above[x]
        return x

    def close(name: object, part: _Part, birth: float, parent: int) -> float:
        own = part.mass - birth * part.size
        wins = not (part.split and part.below > own)
        emit(what="cluster", a=name, cluster=part.cluster, split=wins, parent=parent)
        return own if wins else part.below

    edges = edges.sort_values("k")
    for k, d, a, b in zip(edges.k.tolist(), edges.d.tolist(), edges.a.tolist(), edges.b.tolist(), strict=True):
        a, b = sorted((find(a), find(b)))
        density = 1.0 / max(d, 1e-12)
        x, y = (parts.pop(n, None) or _Part(1, [n]) for n in (a, b))
        above[b] = a
        size = x.size + y.size
        if size < least:
            new = _Part(size, x.rows + y.rows)
        elif x.rows is None and y.rows is None:
            new = _Part(size, None, k, size * density, close(a, x, density, k) + close(b, y, density, k), True)
        else:
            small = [p for p in (x, y) if p.rows is not None]
            big = x if x.rows is None else y
            new = _Part(size, None, k) if len(small) == 2 else big
            for p in small:
                new.mass += p.size * density
                emit(what="rows", cluster=new.cluster, members=p.rows)
            new.size = size
        parts[a] = new
    for name, part in parts.items():
        if after[name] >= 0:
            emit(what="part", to=after[name], a=name, sa=part.size, cluster=part.cluster, mass=part.mass, below=part.below, split=part.split, members=part.rows)
        elif part.cluster >= 0:
            emit(what="cluster", a=name, cluster=part.cluster, split=False, parent=-1)  # the whole is no cluster
    return out


#: Of a run: ``part``s for the run ``to``, ``cluster``s that ended (a: smallest row, split: whether it outweighs what is below it), and the ``rows`` (members) that lie in a cluster and in none below it.
_OUT = "what string, to int, a {0}, sa long, cluster long, mass double, below double, split boolean, members array<{0}>, parent long"


def tree_labels(tree: DataFrame, min_cluster_size: int = 2) -> DataFrame:
    """(id, label) of the rows in a cluster, from the edges (d, i, j) of a least spanning tree, equal d in the order of i and j.

    Clusters are chosen by excess of mass, the whole table being none, and numbered by their smallest rows. Other rows are noise and not returned.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has two rows at least")
    spark, kind = tree.sparkSession, tree.schema["i"].dataType.simpleString()
    edges, runs = _runs(tree)
    touched = edges.select("run", "a").unionByName(edges.select("run", F.col("b").alias("a"))).distinct()
    follow = F.lead("run", 1, -1).over(Window.partitionBy("a").orderBy("run"))  # a row for each run that has the node
    columns = ["run", "what", "k", "d", "a", "sa", "b", "cluster", "mass", "below", "split", "members"]
    # no nulls among whole numbers, which pandas would make fractions
    none = {"k": F.lit(-1).cast("long"), "d": F.lit(0.0), "b": F.col("a"), "cluster": F.lit(-1).cast("long"), "mass": F.lit(0.0), "below": F.lit(0.0), "split": F.lit(False), "members": F.lit(None).cast(f"array<{kind}>")}

    def lines(df: DataFrame, what: int) -> DataFrame:
        return df.withColumn("what", F.lit(what)).select(*(F.col(c) if c in df.columns or c == "what" else none[c].alias(c) for c in columns))

    path = fresh_path(spark)
    both = lines(edges.drop("sb"), 0).unionByName(lines(touched.withColumn("sa", follow.cast("long")), 1))
    both.repartition(max(1, min(runs, 1000)), "run").write.partitionBy("run").parquet(f"{path}/runs")
    given = spark.read.schema(both.schema).parquet(f"{path}/runs")
    done: DataFrame | None = None
    schema = _OUT.format(kind)
    found_columns = [c.split()[0] for c in schema.split(", ")]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_merged(pdf, min_cluster_size), columns=found_columns, dtype=object)

    for run in range(runs):
        now = given.where(F.col("run") == run)
        if run:
            now = now.unionByName(lines(done.where((F.col("to") == run) & (F.col("what") == "part")).withColumn("run", F.col("to")).drop("what"), 2).select(*now.columns))
        found = now.groupBy("run").applyInPandas(merge, schema)
        found.write.mode("append").partitionBy("to", "what").parquet(f"{path}/merged")
        done = spark.read.schema(found.schema).parquet(f"{path}/merged")
    if done is None:
        return spark.createDataFrame([], f"id {kind}, label long")
    clusters = done.where("what = 'cluster'").select("cluster", F.when(F.col("parent") >= 0, F.col("parent")).alias("up"), F.when(F.col("split"), F.struct("cluster", F.col("a").alias("first"))).alias("top"))
    clusters = written(clusters)
    while not clusters.where("up IS NOT NULL").isEmpty():  # each reads off twice as many clusters above it as before
        higher = clusters.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("top").alias("higher"))
        clusters = written(clusters.join(higher, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "top").alias("top")))
    chosen = numbered(clusters.where("top IS NOT NULL").select(F.col("top.cluster").alias("chosen"), F.col("top.first").alias("first")).distinct(), ["first"], "label")
    of = clusters.select("cluster", F.col("top.cluster").alias("chosen")).join(chosen, "chosen").select("cluster", "label")
    rows = done.where("what = 'rows'").select("cluster", F.explode("members").alias("id"))
    return rows.join(of, "cluster").select("id", "label")


def hdbscan_all(vectors: DataFrame, id: str = "id", embedding: str = "embedding", min_cluster_size: int = 2, min_samples: int = 1) -> DataFrame:
    """(id, label) by HDBSCAN over the whole table; noise, and rows whose vector is null or empty or holds a null or non-finite component, is -1.

    Reachability is by ``min_samples`` nearest others. Equal distances merge in the order of their rows' ids.
    """
    labels = tree_labels(reachability_tree(vectors, min_samples, id, embedding), min_cluster_size).withColumnRenamed("id", id)
    return vectors.select(id).join(labels, id, "left").select(F.col(id).alias("id"), F.coalesce("label", F.lit(-1)).cast("long").alias("label"))
