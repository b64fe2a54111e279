"""Hard negatives by a full sort of each anchor's scores.

An anchor scores the rows by an integer inner product, sorts them by score and id, looks up
by binary search where a positive's upper limit falls, and reads on from there until it has
enough rows of other labels or the lower limit is reached. The rows stream past blocks of
anchors; a task keeps, for each positive, only the first rows of its stripe.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.blocks import against_all, by_length, column
from claimweave.operators.tables import written

SCALE = 256
#: Scores of vectors below this squared length are exact in doubles, partial sums included.
MOST_SQUARED = 2.0**53


def usable(vectors: DataFrame, id: str, label: str, embedding: str) -> DataFrame:
    """(id, label, v) of rows with an id, a label, and a vector of finite components."""
    v = column(embedding)
    kind = vectors.schema[embedding].dataType.simpleString()
    rows = vectors.select(column(id).cast("long").alias("id"), column(label).cast("long").alias("label"), (v if kind in ("array<float>", "array<double>") else v.cast("array<double>")).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd)


def _scaled(lists: pa.ListArray):
    """(places, scaled integer vectors) of each length; those too long for exact scores are left out."""
    for at, x in by_length(lists):
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * x)
            fine = (x * x).sum(1) < MOST_SQUARED
        yield at[fine], x[fine]


class _Block:
    """A block of anchors with what each has kept so far; keep(anchor's place, ids, labels, scores) is called for rows in the order of ids."""

    def __init__(self, anchors: pa.RecordBatch):
        self.anchors = anchors.to_pydict()
        self.by_size = {x.shape[1]: (at, x) for at, x in _scaled(anchors.column("v").combine_chunks() if isinstance(anchors.column("v"), pa.ChunkedArray) else anchors.column("v"))}

    def scores(self, rows: pa.RecordBatch):
        """(place of an anchor, ids, labels, scores) for each anchor, over the rows of its vector's length."""
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        for at, x in _scaled(rows.column("v")):
            if x.shape[1] not in self.by_size or not len(at):
                continue
            own, y = self.by_size[x.shape[1]]
            for low in range(0, len(own), most := max(1, (1 << 22) // len(at))):
                found = (y[low : low + most] @ x.T).astype(np.int64)
                for place, score in zip(own[low : low + most].tolist(), found, strict=True):
                    yield place, ids[at], labels[at], score


def _positives(n: int):
    """start, step, finish that keep the first n rows of each anchor's label."""

    def start(anchors: pa.RecordBatch) -> _Block:
        block = _Block(anchors)
        block.kept = [(np.zeros(0, np.int64),) * 2 for _ in block.anchors["id"]]
        return block

    def step(block: _Block, rows: pa.RecordBatch) -> None:
        for place, ids, labels, score in block.scores(rows):
            same = np.flatnonzero((labels == block.anchors["label"][place]) & (ids != block.anchors["id"][place]))
            s, i = (np.concatenate(x) for x in zip(block.kept[place], (score[same], ids[same]), strict=True))
            first = np.lexsort((i, -s))[:n]
            block.kept[place] = s[first], i[first]

    def finish(block: _Block) -> pa.RecordBatch:
        size = [len(s) for s, _ in block.kept]
        key = np.repeat(np.array(block.anchors["key"], np.int64), size)
        s, i = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*block.kept, strict=True))
        return pa.RecordBatch.from_pydict({"key": key, "score": s, "id": i})

    return start, step, finish


def _negatives(k: int, low: int, high: int):
    """start, step, finish that keep, for each positive of each anchor, the first k rows of other labels between its limits."""
    none = (np.zeros(0, np.int64),) * 2

    def start(anchors: pa.RecordBatch) -> _Block:
        block = _Block(anchors)
        block.kept = [[none] * len(p) for p in block.anchors["positives"]]
        return block

    def step(block: _Block, rows: pa.RecordBatch) -> None:
        for place, ids, labels, score in block.scores(rows):
            order = np.lexsort((ids, -score))
            other = order[labels[order] != block.anchors["label"][place]]
            falling = -100 * score[other]
            for rank, positive in enumerate(block.anchors["positives"][place]):
                a = np.searchsorted(falling, -high * positive["score"])
                b = min(np.searchsorted(falling, -low * positive["score"], "right"), a + k)
                if a < b:
                    s, i = (np.concatenate(x) for x in zip(block.kept[place][rank], (score[other[a:b]], ids[other[a:b]]), strict=True))
                    first = np.lexsort((i, -s))[:k]
                    block.kept[place][rank] = s[first], i[first]

    def finish(block: _Block) -> pa.RecordBatch:
        out: dict[str, list] = {"key": [], "place": [], "score": [], "id": []}
        for key, kept in zip(block.anchors["key"], block.kept, strict=True):
            for place, (s, i) in enumerate(kept):
                out["key"] += [key] * len(s)
                out["place"] += [place] * len(s)
                out["score"] += s.tolist()
                out["id"] += i.tolist()
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64())]))

    return start, step, finish


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives, the first k rows of other labels whose score is from low to high per cent of the positive's.

    A component x counts as floor(256 x); a row's score is its inner product with the anchor,
    higher ones come first, ties by smaller id. An anchor's positives are its first other rows
    of its label. anchors: a condition on the columns of vectors; labels and ids are integers.

    Rows without an id or a label, and those whose vector is null or holds a null or non-finite
    component, take no part; nor do vectors so long that a score could leave the exact integers
    of a double (about 370,000 times the unit length). Vectors of different lengths aren't
    compared; empty ones score 0 among themselves. Rows that share an anchor's id are the anchor
    itself, not other rows; anchors alike in all three columns count once, other anchors with a
    repeated id one by one. A negative score of a positive leaves nothing between its limits.
    """
    every = usable(vectors, id, label, embedding)
    chosen = usable(vectors.where(anchors), id, label, embedding).distinct().withColumn("key", F.monotonically_increasing_id())
    chosen = written(chosen)
    found = against_all(chosen, every, *_positives(positives), "key long, score long, id long", "id")
    rank = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    first = found.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= positives)
    listed = first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("positives"))
    asked = written(chosen.join(listed, "key"))
    near = against_all(asked, every, *_negatives(k, low, high), "key long, place int, score long, id long", "id")
    rank = Window.partitionBy("key", "place").orderBy(F.desc("score"), "id")
    near = near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    ends = near.join(asked.select("key", F.col("id").alias("anchor_id"), "positives"), "key").withColumn("p", F.get("positives", F.col("place")))
    return ends.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
