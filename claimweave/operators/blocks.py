"""A set of queries against all rows, in blocks: the rows stream past bounded blocks of queries, and only what the queries keep leaves a task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that a task holds at most on average, and rows that it streams past them.
QUERIES_EACH, ROWS_EACH = 32_768, 1 << 20


def quoted(name: str) -> str:
    """A column's name as Spark's parser takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    return F.col(quoted(name))


def against_all(queries: DataFrame, rows: DataFrame, start: Callable, step: Callable, finish: Callable, schema: str, order: str, queries_each: int = QUERIES_EACH, rows_each: int = ROWS_EACH) -> DataFrame:
    """What each block of queries keeps of each stripe of rows: finish(state) after step(state, rows) over all batches of the stripe.

    start gets a record batch of a block's queries, step one of rows, in the order of the column
    ``order`` throughout the stripe, finish gives a record batch of ``schema``. The number of blocks
    follows the queries, that of stripes the rows; a task holds one block and one batch of rows.
    """
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(queries.count() / queries_each))
    stripes = max(1, math.ceil(wide / blocks), math.ceil(rows.count() / rows_each))
    q, r = F.struct(*map(column, queries.columns)), F.struct(*map(column, rows.columns))
    asked = queries.select(q.alias("q"), F.lit(None).cast(rows.schema).alias("r"))
    asked = asked.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda s: s + F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int") * stripes)))
    told = rows.select(F.lit(None).cast(queries.schema).alias("q"), r.alias("r"))
    told = told.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * stripes + F.pmod(F.xxhash64("r"), F.lit(stripes)).cast("int"))))
    dealt = asked.unionByName(told).repartitionById(blocks * stripes, F.col("cell"))
    ordered = dealt.sortWithinPartitions("cell", F.col("q").isNull(), F.col(f"r.{quoted(order)}"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, state = None, [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if cells[a] != cell:
                    if state is None and held:
                        state = start(_joined(held))
                    if state is not None:
                        yield finish(state)
                    cell, held, state = cells[a], [], None
                part = batch.slice(a, b - a)
                own = part.column("q").is_valid()
                mine, rest = (pa.RecordBatch.from_struct_array(part.column(n).filter(m)) for n, m in (("q", own), ("r", pa.compute.invert(own))))
                if len(mine):
                    held.append(mine)
                if len(rest) and (held or state is not None):
                    if state is None:
                        state, held = start(_joined(held)), []
                    step(state, rest)
        if state is None and held:
            state = start(_joined(held))
        if state is not None:
            yield finish(state)

    return ordered.mapInArrow(task, schema)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix in doubles) of the lists of each length; lists without nulls."""
    if not len(lists):
        return
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        if n * len(lists) == ends[-1] - ends[0] and len(at) == len(lists):
            yield at, values[ends[0] : ends[-1]].reshape(len(at), n).astype(float)
        else:
            yield at, values[ends[at][:, None] + np.arange(n)].astype(float)
