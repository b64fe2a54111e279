"""Shuffles of packed arrays, and tables written to the shared folder.

A row per 64-bit key costs a shuffle several times the key. Here a map task packs the keys
of one chunk that go to one reducer into a single row of byte arrays, and the reducer works
on whole arrays. Spark still moves, spills and recomputes the rows, so a lost executor costs
only its own tasks.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.tables import shared_folder, written

__all__ = ["PACKED", "Unpacked", "any_names", "dealt", "fanout", "free", "hashable", "mapped", "others", "pack", "planes", "shared_folder", "shuffles_freed", "spread", "unplanes", "written"]

PARTS = ("ids", "extra", "lens", "keys", "places", "values")
PACKED = "slot int, " + ", ".join(f"{n} binary" for n in PARTS)
_SCHEMA = pa.schema([("slot", pa.int32())] + [(n, pa.binary()) for n in PARTS])


def fanout(df: DataFrame, bytes_each: int = 10 << 20) -> int:
    """Partitions for a shuffle of about the size of ``df``: the session's number, or more if each would exceed ``bytes_each``.

    The size is that of the tables read, which is known; that of a plan with joins is a product
    of estimates. A source of unknown size counts as four shares for each of its partitions.
    There is no upper bound, so that a reducer's share doesn't grow with the data.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n = 0.0
    for leaf in map(leaves.apply, range(leaves.size())):
        size = int(str(leaf.stats().sizeInBytes()))
        n += size / bytes_each if size < 1 << 60 else 4 * leaf.rdd().getNumPartitions()
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n))


def any_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator for columns of any name: those with a dot or a backtick, which expressions read as something else, have plain names while it runs.

    The names of the first DataFrame given come back in the result; an argument that is such a
    name means the column. Without such columns nothing changes.
    """

    @wraps(operator)
    def run(*given, **named) -> DataFrame:
        back: dict[str, str] = {}
        plain: dict[str, str] = {}

        def renamed(x: object) -> object:
            if not isinstance(x, DataFrame):
                return x
            odd = [c for c in x.columns if "." in c or "`" in c]
            if not odd:
                return x
            names = {c: free(x, f"odd_{k}")[0] for k, c in enumerate(odd)}
            if not back and not plain:
                back.update({n: c for c, n in names.items()})
            plain.update(names)
            return x.toDF(*(names.get(c, c) for c in x.columns))

        first = next((x for x in given if isinstance(x, DataFrame)), None)
        keep = first is not None and any("." in c or "`" in c for c in first.columns)
        given = [renamed(x) for x in given]
        named = {k: plain.get(v, v) if isinstance(v, str) else renamed(v) for k, v in named.items()}
        out = operator(*given, **named)
        return out.toDF(*(back.get(c, c) for c in out.columns)) if keep else out

    return run


def others(df: DataFrame, new: tuple[str, ...] | list[str]) -> list[str]:
    """The columns of df that aren't named like a new one; case makes no difference, as in Spark."""
    gone = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in gone]


def hashable(df: DataFrame, column: str) -> Column:
    """The column as Spark can hash it: maps and variants as JSON."""
    kind = df.schema[column].dataType.simpleString()
    return F.to_json(F.struct(F.col(f"`{column}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{column}`")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def spread(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions an integer that Spark's hash partitioning sends there, so that slots fill partitions evenly."""
    found: dict[int, int] = {}
    have = 0
    while len(found) < n:
        more = _murmur3(np.arange(have, have + 4 * n + 64, dtype=np.int64))
        for v, p in enumerate((more % n).tolist(), have):
            found.setdefault(p, v)
        have += len(more)
    return [found[p] for p in range(n)]


def _murmur3(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Murmur3 x86-32 of 4-byte integers, as signed numbers: the hash behind Spark's hash partitioning."""
    m = np.uint64(0xFFFFFFFF)
    rotl = lambda x, r: ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & m
    k = (rotl((values.astype(np.uint64) & m) * np.uint64(0xCC9E2D51) & m, 15) * np.uint64(0x1B873593)) & m
    h = (rotl(np.uint64(seed) ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & m
    h ^= np.uint64(4)
    h ^= h >> np.uint64(16)
    h = h * np.uint64(0x85EBCA6B) & m
    h ^= h >> np.uint64(13)
    h = h * np.uint64(0xC2B2AE35) & m
    h ^= h >> np.uint64(16)
    return h.astype(np.uint32).view(np.int32).astype(np.int64)


def planes(a: np.ndarray) -> bytes:
    """Bytes of integers by significance, so that the zero bytes of small numbers lie together and compress."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(
    slots: list[int], slot_of: np.ndarray, owner: np.ndarray, keys: np.ndarray | None, ids: np.ndarray, extra: np.ndarray | None = None, places: np.ndarray | None = None, values: np.ndarray | None = None
) -> pa.RecordBatch:
    """One row for each slot that gets any key.

    owner: index into ids (and extra) of each key, ascending; places: an ascending number for
    each key within its owner, sent as differences; values: any unsigned 32-bit number for each
    key; all three can be left out. Runs of one owner send its id once.
    """
    n = len(slots)
    order = np.argsort(slot_of.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
    slot, own, key = slot_of[order], owner[order], keys[order] if keys is not None else None
    bound = np.searchsorted(slot, np.arange(n + 1))
    head = np.ones(len(own), bool)
    head[1:] = (own[1:] != own[:-1]) | (slot[1:] != slot[:-1])
    runs = np.flatnonzero(head)
    run_len = np.diff(np.append(runs, len(own))).astype(np.uint32)
    run_id = ids[own[runs]]
    run_extra = extra[own[runs]] if extra is not None else None
    run_bound = np.searchsorted(runs, bound)
    step = None
    if places is not None:
        at = places[order].astype(np.uint32)
        step = at.copy()
        step[1:] -= at[:-1]
        step[runs] = at[runs]
    value = values[order].astype(np.uint32) if values is not None else None
    out: dict[str, list] = {name: [] for name in _SCHEMA.names}
    for s in np.flatnonzero(np.diff(bound)):
        a, b, ra, rb = bound[s], bound[s + 1], run_bound[s], run_bound[s + 1]
        out["slot"].append(slots[s])
        out["ids"].append(run_id[ra:rb].tobytes())
        out["extra"].append(planes(run_extra[ra:rb]) if run_extra is not None else b"")
        out["lens"].append(planes(run_len[ra:rb]))
        out["keys"].append(key[a:b].tobytes() if key is not None else b"")
        out["places"].append(planes(step[a:b]) if step is not None else b"")
        out["values"].append(planes(value[a:b]) if value is not None else b"")
    return pa.RecordBatch.from_pydict(out, schema=_SCHEMA)


class Unpacked:
    """All rows of a partition: for each key its value and its run; for each run its id and extra."""

    def __init__(self, batches: Iterator[pa.RecordBatch], extra_type: type = np.uint32):
        kinds = {"ids": None, "extra": extra_type, "lens": np.uint32, "keys": None, "places": np.uint32, "values": np.uint32}
        parts: dict[str, list] = {n: [] for n in PARTS}
        for batch in batches:
            for name, kind in kinds.items():
                raw = batch.column(name).to_pylist()
                parts[name] += [np.frombuffer(x, np.uint64) if kind is None else unplanes(x, kind) for x in raw]
        join = lambda name, kind: np.concatenate(parts.pop(name)) if parts[name] else np.zeros(0, kind or np.uint64)
        self.ids, self.extra, self.lens, self.keys, steps, self.values = (join(n, k) for n, k in kinds.items())
        self.run = np.repeat(np.arange(len(self.lens), dtype=np.uint32), self.lens)
        self.places = None
        if len(steps):
            total = np.cumsum(steps, dtype=np.int64)
            heads = np.cumsum(self.lens, dtype=np.int64) - self.lens
            total -= (total[heads] - steps[heads])[self.run]
            self.places = total.astype(np.uint32)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema), after which a task gives its free memory back: workers are kept, and what they hold would add up over stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return df.mapInArrow(task, schema)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of an action go once it ends, instead of when the driver happens to collect its garbage.

    For frames that one action runs; a second action on the same frame would shuffle again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def dealt(df: DataFrame, pack_batches: Callable, n: int) -> DataFrame:
    """Rows of ``PACKED`` from pack_batches over df's Arrow batches, dealt to n partitions by slot."""
    return df.transform(mapped, pack_batches, PACKED).repartition(n, "slot")
