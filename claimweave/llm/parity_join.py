"""N-gram Jaccard self-join by parity sketches, and the components of its links.

A document's set is its distinct word shingles, hashed to 64 bits. Two documents whose sets
have a Jaccard index of at least t differ in at most (1-t)/(1+t) * (|A|+|B|) shingles.

1. Shared shingles. All (shingle, set) rows are sorted by shingle over packed arrays; shingles
   of one set only are counted and left there. A set with too few shared shingles has no link
   (100 * shared < 100t * size), which settles most documents without any candidate pair.
2. Sketches. A set XORs each shared shingle into one of k segments of its sketch, k by size
   band. Each differing shingle changes one segment, so the number of differing segments
   bounds the symmetric difference from below: of a set's non-empty segments all but d are
   equal to the other's. A set with d non-empty ones or fewer adds another seed, and so on,
   so of two linked sets one is sound at a seed that both have used.
3. Pigeonhole join on (band, seed, segment, value). A bit sketch of 512 parities rejects pairs
   whose Hamming distance is beyond the bound; the rest are verified on the shingle sets.
   First each member is tested against one hub of its group, then against six, and last all
   pairs of the groups that are larger and still have several parts. Only pairs between
   different components are tested after the first round, as others change nothing.

Exact copies share one set and are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.components import components
from .exchange import Unpacked, dealt, fanout, mapped, pack, spread, written
from .wordarrays import chunks, mix64, spans, windows

WORDS, PERCENT, BITS, SEEDS = 5, 75, 512, 16
#: Shingles that so many sets of a chunk share are remembered by the task, at most so many of them, and so many sets' keys.
OFTEN, MOST_OFTEN, MOST_SENT = 4, 1 << 16, 1 << 18
_ODD = mix64(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)
_U = np.uint64


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(low, high, sets) by chunk: each text's distinct shingle hashes, ascending. A-Z count as a-z; a text of fewer words has its whole sequence as one."""
    for low, high, data, off in chunks(texts):
        w = spans(data, off)
        tokens = w.hashes(fold=True)
        at = windows(w.first, words)
        with np.errstate(over="ignore"):
            value = np.zeros(len(at), _U)
            for j in range(words):
                value += tokens[at + j] * _ODD[j]
        value = mix64(value)
        bound = np.searchsorted(at, w.first)
        sets = []
        for i, n in enumerate(w.counts):
            if n >= words:
                own = np.sort(value[bound[i] : bound[i + 1]])
                sets.append(own[np.append(True, own[1:] != own[:-1])])
            elif n:
                with np.errstate(over="ignore"):
                    sets.append(mix64(np.array([(tokens[w.first[i] : w.first[i + 1]] * _ODD[:n]).sum() + _U(n)], _U)))
            else:
                sets.append(np.zeros(0, _U))
        yield low, high, sets


def set_key(own: np.ndarray) -> np.uint64:
    """A 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        return mix64(np.array([mix64(own ^ _U(0xA5A5A5A5A5A5A5A5)).sum() + _U(len(own)) * _ODD[9]], _U))[0]


def most_differences(a: int, b: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of sets of sizes a and b whose Jaccard index is percent/100 or more."""
    return (100 - percent) * (a + b) // (100 + percent)


def bounds(size: int) -> list[int]:
    """Least sizes of the size bands, up to one beyond ``size``: steps of a seventh, or 1."""
    out = [1]
    while out[-1] <= size:
        out.append(max(out[-1] + 1, out[-1] * 8 // 7))
    return out


def bands(size: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(band, k, d) of the joins that a set takes part in: with sets of its own band, and of higher bands as the smaller one.

    k: segments of all sketches of the band. d bounds this set's differences from any set
    in the band that it may be linked to and that isn't smaller, or is of its own band.
    """
    largest = size * 100 // percent
    least = bounds(largest)
    out = []
    for band, low in enumerate(least[:-1]):
        top = least[band + 1] - 1
        if top >= size and low <= largest:
            all_d = most_differences(top, top, percent)
            out.append((band, all_d + 1 + math.ceil(0.12 * all_d), most_differences(size, min(top, largest), percent)))
    return out


def signatures(own: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
    """64-bit keys of all non-empty segments, over bands and as many seeds as it takes. own: those of the set's shingles that other sets share; size: of the whole set.

    The shingles that are missing from ``own`` are differences from every other set already, so
    that many fewer are left for the shared ones.
    """
    keys = []
    missing = size - len(own)
    for band, k, d in bands(size, percent):
        if d < missing:
            continue
        for seed in range(SEEDS):
            mixed = mix64(own + _U((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if seed else own
            place = (mixed % _U(k)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            at = place[order]
            heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            value = np.bitwise_xor.reduceat(own[order], heads)
            with np.errstate(over="ignore"):
                keys.append(mix64(value * _ODD[1] + at[heads].astype(_U) * _ODD[2] + _U(band * 64 + seed) * _ODD[3]))
            if len(heads) > d - missing:
                break
        else:  # unsound under all seeds: then each shared shingle is a key, with no bound needed; both of an unsound pair have it
            with np.errstate(over="ignore"):
                keys.append(mix64(own * _ODD[4] + _U(band) * _ODD[5]))
    return np.concatenate(keys) if keys else np.zeros(0, _U)


def parity(own: np.ndarray, bits: int = BITS) -> np.ndarray:
    return np.packbits((np.bincount((mix64(own) % _U(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def membership(docs: DataFrame, id: Column, text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, set, n_shingles) of each row; set is null for a text without words."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, sets in shingle_sets(batch.column(1), words):
                n = np.array([len(s) for s in sets], np.int64)
                key = np.array([set_key(s) for s in sets], _U).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(key, mask=n == 0), pa.array(n)], ["doc_id", "set", "n_shingles"])

    source = docs.select(id.alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.transform(mapped, sizes, f"doc_id {kind}, set long, n_shingles long")


def shared_sets(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(set, size, shared): the sets that can have a link, with those of their shingles that another set has too.

    A shingle of several sets of one chunk is shared, so it goes straight to their rows, and its
    reducer gets it once for the chunk, marked by a size of 0. A task remembers sets that it has
    sent, and shingles that many sets share. So neither a line nor a text that a third of all
    documents has sends a reducer more than a few keys for each task.
    """
    n = fanout(docs)
    slots = spread(docs.sparkSession, n)

    def slot_of(x: np.ndarray) -> np.ndarray:
        return (x % _U(n)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        often = np.zeros(0, _U)  # ascending
        for batch in batches:
            for _, _, sets in shingle_sets(batch.column(0), words):
                known = {}
                for s in sets:
                    if len(s) and (name := int(set_key(s))) not in sent:
                        known.setdefault(name, s)
                if not known:
                    continue
                if len(sent) > MOST_SENT:
                    sent.clear()
                sent.update(known)
                own, names = list(known.values()), np.array(list(known), _U)
                sizes = np.array([len(s) for s in own], np.uint32)
                keys, owner = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
                order = np.argsort(keys, kind="stable")
                head = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
                times = np.diff(np.append(head, len(keys)))
                seen = np.isin(keys[order[head]], often) if len(often) else np.zeros(len(head), bool)
                settled = np.zeros(len(keys), bool)
                settled[order[np.repeat((times > 1) | seen, times)]] = True
                if settled.any():
                    yield _direct(pack(slots, slot_of(mix64(names))[owner[settled]], owner[settled], keys[settled], names, extra=sizes))
                    first = order[head[(times > 1) & ~seen]]
                    if len(first):
                        yield pack(slots, slot_of(keys[first]), np.zeros(len(first), np.int64), keys[first], np.zeros(1, _U), extra=np.zeros(1, np.uint32))
                    more = keys[order[head[(times >= OFTEN) & ~seen]]]
                    if len(more):
                        often = np.union1d(often, more) if len(often) + len(more) <= MOST_OFTEN else np.unique(more)[:MOST_OFTEN]
                left = ~settled
                if left.any():
                    yield pack(slots, slot_of(keys[left]), owner[left], keys[left], names, extra=sizes)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled: list[pa.RecordBatch] = []

        def others() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                straight = pc.greater(pc.binary_length(batch.column("values")), 0)
                settled.append(batch.filter(straight))
                yield batch.filter(pc.invert(straight))

        got = Unpacked(others())
        empty = pa.array([b""], pa.binary())
        for b in settled:
            if b.num_rows:
                yield b.set_column(b.schema.get_field_index("values"), "values", empty.take(pa.array(np.zeros(b.num_rows, np.int64))))
        order = np.argsort(got.keys)
        key = got.keys[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]
        key, run = got.keys[order], got.run[order]
        sets, size = got.ids[run], got.extra[run]
        by = np.lexsort((sets, size > 0, key))  # marks first
        key, sets, size = key[by], sets[by], size[by]
        if not len(key):
            return
        new = np.append(True, (key[1:] != key[:-1]) | (sets[1:] != sets[:-1]) | ((size[1:] > 0) != (size[:-1] > 0)))
        key, sets, size = key[new], sets[new], size[new]
        same = key[1:] == key[:-1]  # now of different sets, or marked
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        twice &= size > 0
        key, sets, size = key[twice], sets[twice], size[twice]
        by = np.argsort(sets, kind="stable")
        key, sets, size = key[by], sets[by], size[by]
        heads = np.flatnonzero(np.append(True, sets[1:] != sets[:-1])) if len(sets) else np.zeros(0, np.int64)
        if len(heads):
            owner = np.cumsum(np.append(True, sets[1:] != sets[:-1])) - 1
            yield pack(slots, slot_of(mix64(sets)), owner, key, sets[heads], extra=size[heads])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Unpacked(batches)
        sets = got.ids[got.run]
        order = np.lexsort((got.keys, sets))
        sets, key, size = sets[order], got.keys[order], got.extra[got.run[order]]
        if not len(sets):
            return
        new = np.append(True, (sets[1:] != sets[:-1]) | (key[1:] != key[:-1]))  # copies of a set in several tasks
        sets, key, size = sets[new], key[new], size[new]
        heads = np.flatnonzero(np.append(True, sets[1:] != sets[:-1]))
        ends = np.append(heads[1:], len(sets))
        keep = 100 * (ends - heads) >= percent * size[heads].astype(np.int64)
        heads, ends = heads[keep], ends[keep]
        for k in range(0, len(heads), 500):
            a, b = heads[k : k + 500], ends[k : k + 500]
            yield pa.RecordBatch.from_arrays([pa.array(sets[a].view(np.int64)), pa.array(size[a].astype(np.int64)), pa.array([key[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())], ["set", "size", "shared"])

    found = dealt(docs.select(F.col(text).cast("string").alias("text")), send, n)
    return dealt(found, match, n).transform(mapped, gather, "set long, size long, shared binary")


def _direct(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that reducers hand on as they are."""
    return batch.set_column(batch.schema.get_field_index("values"), "values", pa.array([b"d"] * batch.num_rows, pa.binary()))


def candidates(sets: DataFrame, hubs: int | None, n: int, bits: int = 0, percent: int = PERCENT) -> DataFrame:
    """Distinct (a, b), a < b, of sets in different parts that share a sketch segment.

    sets: (set, size, shared, part), part being the component so far; n: reducers. With hubs,
    the first so many members of each group, in an order that is the same in all groups, pair
    with all its members, which covers groups of up to hubs + 1; the members of larger groups
    that have several parts are returned too, as (a, a). Without, all pairs of groups count.
    Pairs whose sizes or, if bits are given, parity sketches rule out a link are left out. The pairs of a reducer
    go packed to reducers of pairs, since a pair shares many segments.
    """
    slots = spread(sets.sparkSession, n)
    record = np.dtype([("size", "<u4"), ("missing", "<u4"), ("part", "<u8"), ("parity", "u1", bits // 8)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, parts = (batch.column(i).to_numpy() for i in (0, 1, 3))
            shared = batch.column(2)
            for low in range(0, len(names), 1000):
                own = [np.frombuffer(x.as_buffer(), _U) for x in shared.slice(low, 1000)]
                keys = [signatures(s, int(z), percent) for s, z in zip(own, sizes[low:], strict=False)]
                extra = np.zeros(len(own), record)
                extra["size"], extra["part"] = sizes[low : low + 1000], parts[low : low + 1000].view(_U)
                extra["missing"] = extra["size"] - [len(s) for s in own]
                if bits:
                    extra["parity"] = np.stack([parity(s, bits) for s in own])
                flat = np.concatenate(keys)
                yield pack(slots, (flat % _U(n)).astype(np.int64), np.repeat(np.arange(len(own)), [len(k) for k in keys]), flat, names[low : low + 1000].view(_U), extra=extra)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Unpacked(batches, record)
        if not len(got.keys):
            return
        known, first, local = np.unique(got.ids, return_index=True, return_inverse=True)
        size, part = got.extra["size"][first].astype(np.int64), got.extra["part"][first]
        missing = got.extra["missing"][first].astype(np.int64)
        sketch = np.ascontiguousarray(got.extra["parity"][first]).view(_U) if bits else None
        who = local[got.run]
        order = np.lexsort((mix64(known)[who], got.keys))
        key, who = got.keys[order], who[order]
        new = np.append(True, (key[1:] != key[:-1]) | (who[1:] != who[:-1]))
        key, who = key[new], who[new]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.diff(np.append(heads, len(key)))
        group = np.repeat(np.arange(len(heads)), counts)
        own = part[who]
        waiting: list[np.ndarray] = []

        def settle() -> Iterator[pa.RecordBatch]:
            """Pairs that wait, each once, as far as their sketches allow a link."""
            code = np.unique(np.concatenate([*waiting, np.zeros(0, np.int64)]))
            waiting.clear()
            for k in range(0, len(code), 100_000):
                x, y = np.divmod(code[k : k + 100_000], len(known))
                if bits:
                    ok = (x == y) | _near(sketch[x], sketch[y], size[x], size[y], missing[x], missing[y], percent)
                    x, y = x[ok], y[ok]
                if len(x):
                    head = np.append(True, x[1:] != x[:-1])
                    a, b = known[x], known[y]
                    yield pack(slots, (mix64(a ^ mix64(b)) % _U(n)).astype(np.int64), np.cumsum(head) - 1, b, a[head])

        def add(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            differ = own[i] != own[j]
            x, y = who[i[differ]], who[j[differ]]
            fit = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
            fit &= (100 + percent) * (missing[x] + missing[y]) <= (100 - percent) * (size[x] + size[y])
            x, y = x[fit], y[fit]
            waiting.append(np.minimum(x, y) * len(known) + np.maximum(x, y))
            if sum(map(len, waiting)) > 3_000_000:
                waiting[:] = [np.unique(np.concatenate(waiting))]
                if len(waiting[0]) > 1_500_000:
                    yield from settle()

        if hubs:
            at = np.arange(len(key)) - heads[group]
            for h in range(hubs):
                j = np.flatnonzero(at > h)
                yield from add(heads[group[j]] + h, j)
            several = np.logical_or.reduceat(own != own[heads][group], heads) & (counts > hubs + 1)
            left = np.unique(who[several[group]])
            waiting.append(left * len(known) + left)
        else:
            end = (heads + counts)[group]
            i, step = np.arange(len(key)), 0
            while len(i):  # each member with the one that comes so many places later, as long as the group goes on
                step += 1
                i = i[i + step < end[i]]
                yield from add(i, i + step)
        yield from settle()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Unpacked(batches)
        if len(got.keys):
            yield _pairs(np.unique(np.stack([got.ids[got.run], got.keys], 1), axis=0))

    return dealt(dealt(sets.select("set", "size", "shared", "part"), send, n), match, n).transform(mapped, merge, "a long, b long")


def _near(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, missing_x: np.ndarray, missing_y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the Hamming distance of sketches, and the shingles that no other set has, leave a link possible."""
    apart = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) + missing_x + missing_y
    return (100 + percent) * apart <= (100 - percent) * (size_x + size_y)


def sketches(sets: DataFrame, bits: int = BITS) -> DataFrame:
    """(set, size, missing, parity)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), _U) for x in batch.column(2)]
            missing = batch.column(1).to_numpy() - np.array([len(s) for s in own], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(missing, pa.int64()), pa.array([parity(s, bits).tobytes() for s in own], pa.binary())], ["set", "size", "missing", "parity"])

    return sets.select("set", "size", "shared").transform(mapped, make, "set long, size long, missing long, parity binary")


def near(pairs: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those (a, b) that their sketches allow to be linked."""
    side = lambda x: known.select(F.col("set").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("size", "missing", "parity")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb, ma, mb = (batch.column(i).to_numpy() for i in range(6))
            x, y = (np.stack([np.frombuffer(v.as_buffer(), _U) for v in batch.column(i)]) for i in (6, 7))
            ok = _near(x, y, na, nb, ma, mb, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return both.select("a", "b", "a_size", "b_size", "a_missing", "b_missing", "a_parity", "b_parity").transform(mapped, test, "a long, b long")


def _pairs(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those (a, b) whose Jaccard index, counted on the sets, is percent/100 or more."""
    side = lambda x: sets.select(F.col("set").alias(x), F.col("size").alias(f"{x}_size"), F.col("shared").alias(f"{x}_shared"))
    both = pairs.join(side("a").hint("shuffle_merge"), "a").join(side("b").hint("shuffle_merge"), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            ok = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                common = len(np.intersect1d(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), assume_unique=True))
                ok[i] = 100 * common >= percent * (int(na[i]) + int(nb[i]) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return both.select("a", "b", "a_size", "b_size", "a_shared", "b_shared").transform(mapped, test, "a long, b long")


def linked_sets(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT, hubs: int = 6) -> DataFrame:
    """(node, part): each set that has a link, and the smallest set of its component."""
    sets = written(shared_sets(docs, text, words, percent))
    known = written(sketches(sets))
    n = groups(sets)
    first = candidates(sets.withColumn("part", F.col("set")), 1, n, percent=percent).where("a <> b")
    links = written(verified(near(first, known, percent), sets, percent))
    found = written(candidates(_labelled(sets, components(links)), hubs, n, percent=percent))
    links = written(links.unionByName(verified(near(found.where("a <> b"), known, percent), sets, percent)))
    left = found.where("a = b").select(F.col("a").alias("set"))
    parts = written(components(links))
    some = written(_labelled(sets.join(left, "set", "left_semi"), parts))
    more = verified(candidates(some, None, n, 4 * BITS, percent), sets, percent)
    return written(components(links.unionByName(more)))


def groups(sets: DataFrame, bytes_each: int = 12 << 20) -> int:
    """Reducers of sketch segments, by the size of the sets alone: each set sends its own particulars to each of them."""
    return max(12, math.ceil(int(str(sets._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / bytes_each))


def _labelled(sets: DataFrame, parts: DataFrame) -> DataFrame:
    return sets.join(parts.withColumnRenamed("node", "set"), "set", "left").withColumn("part", F.coalesce("part", "set"))


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row, component_id being the smallest id reachable by links.

    A null or empty text has no shingles, no link and its own id. Rows alike in all columns
    stay two rows of one component. A null id is never the smallest, unless all are null.
    Other columns are not read. An empty table gives an empty result.
    """
    every = written(membership(docs, F.col(id), text, words))
    parts = linked_sets(docs, text, words, percent)
    classes = every.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"))
    classes = classes.join(parts.withColumnRenamed("node", "set"), "set", "left").withColumn("part", F.coalesce("part", "set"))
    least = classes.groupBy("part").agg(F.min("least").alias("component_id"))
    by_set = classes.join(least, "part").select("set", "component_id")
    return every.join(by_set, "set", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
