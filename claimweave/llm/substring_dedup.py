"""Substring dedup: repeated token windows, found by Rabin-Karp hashes, merge into removal intervals.

Every window of ``width`` consecutive words of every text gets three polynomial hashes modulo
primes. Two make a 64-bit key, the third picks the reducer, which sorts its keys: a key there
twice is a repeated window, wherever it starts. Reducers send back the window positions for
each row, the row's windows merge into maximal intervals, and the words in them go.

A window that repeats within a chunk of texts is known to repeat there and then: its positions
go straight to their rows, and the reducer gets one key for the whole chunk, marked as
repeated. Windows that many texts of a task share are remembered and not sent again. So a
passage in a third of all documents sends its reducer a few keys for each task.

Two different windows share all three hashes with a chance of 2**-64 over the number of
reducers. Rows are known by xxhash64 of id and text, and rows alike in both are each removed
in the same way; of n different rows two share that hash with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import Unpacked, any_names, dealt, fanout, free, mapped, others, pack, spread
from .wordarrays import chunks, mix64, rabin_karp, spans, windows

WIDTH = 35
#: (prime, base) of the polynomial hashes: two for the key, one for the slot.
#: Windows that stand so often in a chunk are remembered by the task, at most so many of them.
OFTEN, MOST_KNOWN = 4, 1 << 16
_PRIMES = ((4294967291, 2654435761), (4294967279, 2246822519), (2147483647, 1597334677))


def repeated_windows(docs: DataFrame, row: Column, text: str = "text", width: int = WIDTH) -> DataFrame:
    """(row, gone): for each row with a repeated window its maximal intervals of such words, as packed unsigned 32-bit [start, end) pairs."""
    n = fanout(docs)
    slots = spread(docs.sparkSession, n)

    def slot_of(x: np.ndarray) -> np.ndarray:
        return (mix64(x) % np.uint64(n)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)  # ascending
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            for low, high, data, off in chunks(batch.column(1)):
                words = spans(data, off)
                at = windows(words.first, width)
                if not len(at):
                    continue
                tokens = words.hashes()
                high_bits, low_bits, route = (rabin_karp(tokens, at, width, p, b) for p, b in _PRIMES)
                key = (high_bits << np.uint64(32)) | low_bits
                owner = np.searchsorted(words.first, at, "right") - 1
                place, slot, own = at - words.first[owner], slot_of(route), ids[low:high]
                order = np.argsort(key, kind="stable")
                head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
                times = np.diff(np.append(head, len(key)))
                seen = np.isin(key[order[head]], known) if len(known) else np.zeros(len(head), bool)
                here = np.repeat((times > 1) | seen, times)
                settled = np.zeros(len(key), bool)
                settled[order[here]] = True
                if settled.any():  # straight to their rows, without keys
                    yield pack(slots, slot_of(own)[owner[settled]], owner[settled], None, own, extra=np.zeros(high - low, np.uint8), places=place[settled])
                    first = order[head[(times > 1) & ~seen]]  # one of each, marked
                    if len(first):
                        yield pack(slots, slot[first], np.zeros(len(first), np.int64), key[first], np.zeros(1, np.uint64), extra=np.ones(1, np.uint8), places=np.zeros(len(first), np.uint32))
                    often = key[order[head[(times >= OFTEN) & ~seen]]]
                    if len(often):
                        known = np.union1d(known, often) if len(known) + len(often) <= MOST_KNOWN else np.unique(often)[:MOST_KNOWN]
                left = ~settled
                if left.any():
                    yield pack(slots, slot[left], owner[left], key[left], own, extra=np.zeros(high - low, np.uint8), places=place[left])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled: list[pa.RecordBatch] = []

        def keyed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                plain = pc.equal(pc.binary_length(batch.column("keys")), 0)
                settled.append(batch.filter(plain))
                yield batch.filter(pc.invert(plain))

        got = Unpacked(keyed(), np.uint8)
        yield from (b for b in settled if b.num_rows)
        order = np.argsort(got.keys).astype(np.uint32)
        key = got.keys[order]
        marked = got.extra[got.run[order]] > 0
        del got.keys
        same = key[1:] == key[:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = order[twice & ~marked]  # a marked key is no window of its own, and its places are settled
        run = got.run[found]
        ids, places = got.ids[run], got.places[found] if len(found) else np.zeros(0, np.uint32)
        order = np.lexsort((places, ids))
        ids, places = ids[order], places[order]
        if len(ids):
            head = np.append(True, ids[1:] != ids[:-1])
            yield pack(slots, slot_of(ids), np.cumsum(head) - 1, None, ids[head], extra=np.zeros(int(head.sum()), np.uint8), places=places)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Unpacked(batches, np.uint8)
        ids = got.ids[got.run]
        if not len(ids):
            return
        order = np.lexsort((got.places, ids))
        ids, places = ids[order], got.places[order]
        head = np.append(True, (ids[1:] != ids[:-1]) | (places[1:] > places[:-1] + np.uint32(width)))
        begin = np.flatnonzero(head)
        end = np.append(begin[1:], len(ids)) - 1
        limits = np.stack([places[begin], places[end] + width], 1).astype("<u4")
        ids = ids[begin]
        rows = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ends = np.append(rows[1:], len(ids))
        for k in range(0, len(rows), 5000):
            a, b = rows[k : k + 5000], ends[k : k + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a].view(np.int64)), pa.array([limits[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())], ["row", "gone"])

    source = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    return dealt(dealt(source, send, n), match, n).transform(mapped, merge, "row long, gone binary")


def kept_mask(n_words: int, gone: bytes) -> np.ndarray:
    """False for each word in an interval."""
    steps = np.zeros(n_words + 1, np.int64)
    limits = np.frombuffer(gone, "<u4").reshape(-1, 2)
    steps[limits[:, 0]] = 1
    steps[limits[:, 1]] -= 1
    return np.cumsum(steps[:n_words]) == 0


@any_names
def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with n_words, n_removed, kept_text and kept_sha256 of each row.

    kept_text: the text itself if nothing goes, else the kept words joined by one space; null
    for a null text, which counts as empty. kept_sha256 is of the kept words joined by one space
    in either case. Texts of fewer words than the width, and empty ones, keep all; long texts
    take memory in proportion to the longest. A row that stands twice is two documents: its
    windows repeat. Null and repeated ids are ids like others. Other columns pass; columns of
    docs named like the new ones, whatever their case, are replaced. An empty table gives an
    empty result.
    """
    new = ("n_words", "n_removed", "kept_text", "kept_sha256")
    rest = others(docs, new)
    at = [c.lower() for c in rest].index(text.lower())
    key, cuts = free(docs, "row_key", "cuts")
    row = F.xxhash64(F.col(id).cast("string"), F.col(text).cast("string"))
    gone = repeated_windows(docs, row, text, width)
    both = docs.select(*rest, row.alias(key)).join(gone.select(F.col("row").alias(key), F.col("gone").alias(cuts)), key, "left")
    schema = both.select(*rest).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("kept_sha256", "string")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for value, gone in zip(batch.column(at), batch.column(len(rest)).to_pylist(), strict=True):
                value = value.as_py()
                words = b"" if value is None else str(value).encode().split()
                words, n = (words, len(words)) if words else ([], 0)
                if gone:
                    words = list(compress(words, kept_mask(n, gone)))
                joined = b" ".join(words)
                out[0].append(n)
                out[1].append(n - len(words))
                out[2].append(value if len(words) == n else joined.decode())
                out[3].append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(rest))] + [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], [*rest, *new])

    return both.select(*rest, cuts).transform(mapped, finish, schema)
