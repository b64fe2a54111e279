"""Two tokenizers' tokens of the same texts, aligned by a sweep over the places where tokens end.

Each text becomes runs of end events, one row for the tokens of one tokenizer that end within
``STRETCH`` bytes. The rows of both tokenizers are dealt by document and sorted by place; a
machine that holds one open group streams through them, closes a group where tokens of both end,
and sends the pair of tokens that end there: a link. Links are packed in chunks of bounded size,
each with the table of its different pairs, so that the counts of pairs are joined to a chunk's
table and not to each link.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from claimweave.operators.blocks import column
from claimweave.operators.tables import written

from .exchange import fanout, mapped
from .lm_scoring import PATTERN

#: Bytes of a text per row of events, links and parts per chunk, tokens that are swept at once, bytes of texts that are encoded at once.
STRETCH, LINKS, PARTS, SLAB, TEXTS = 1 << 16, 1 << 20, 1 << 16, 1 << 18, 4 << 20


class Tokenizer:
    """A tokenizer by the bytes of its file: encode(text) gives the ids of space + text as numpy integers, pieces has each id's bytes."""

    pieces: list[bytes]

    def encode(self, text: str) -> np.ndarray:
        raise NotImplementedError


class ByteLevel(Tokenizer):
    """A byte-level BPE file (JSON) without further steps than the split of texts into words. Its merges are in the order of ids, so that merging by rank gives its ids."""

    def __init__(self, raw: bytes):
        about = json.loads(raw)
        vocab, split = about["model"]["vocab"], about["pre_tokenizer"]
        if about["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or split.get("add_prefix_space") or about.get("normalizer"):
            raise ValueError("not a plain byte-level BPE")
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in about["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("merges aren't in the order of ids")
        own = {t["content"] for t in about.get("added_tokens", [])}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items() if piece not in own}
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.tokens = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.tokens.encode_to_numpy(" " + text, disallowed_special=())


class Pieces(Tokenizer):
    """A sentencepiece model file; the mark before a text is its own."""

    def __init__(self, raw: bytes):
        self.model = SentencePieceProcessor(model_proto=raw)
        byte = lambda i: bytes([int(self.model.id_to_piece(i)[1:-1], 16)])
        self.pieces = [byte(i) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.uint32)


@lru_cache(4)
def tokenizer(raw: bytes) -> Tokenizer:
    return ByteLevel(raw) if raw.lstrip()[:1] == b"{" else Pieces(raw)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _narrow(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


EVENTS = "h long, m long, doc_id long, stretch long, kind byte, at long, ids binary"


def _events(docs: DataFrame, files: list[bytes]) -> DataFrame:
    """Rows of ``EVENTS``: the ids of tokens that end in a stretch of a document, the first of which begins ``at`` so many bytes. A document without tokens has one row without ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [tokenizer(x) for x in files]
        lens = [np.array([len(p) for p in t.pieces], np.int64) for t in both]
        kinds = [_narrow(len(t.pieces)) for t in both]
        number = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for h, doc_id, text in zip(*(batch.column(c) for c in ("h", "doc_id", "text")), strict=True):
                h, doc_id, text, number = h.as_py(), doc_id.as_py(), text.as_py(), number + 1
                found = []
                if text:
                    whole = (" " + text).encode()
                    for t in both:
                        ids = t.encode(text)
                        if b"".join(map(t.pieces.__getitem__, ids.tolist())) != whole:
                            break
                        found.append(ids)
                if len(found) < 2:
                    out.append((h, number, doc_id, 0, 0, 0, b""))
                else:
                    for kind, ids in enumerate(found):
                        ends = np.cumsum(lens[kind][ids])
                        cuts = [0, *(np.flatnonzero(np.diff((ends - 1) // STRETCH)) + 1).tolist(), len(ids)]
                        for a, b in zip(cuts, cuts[1:], strict=False):
                            out.append((h, number, doc_id, int(ends[a] - 1) // STRETCH, kind, int(ends[a - 1]) if a else 0, ids[a:b].astype(kinds[kind]).tobytes()))
                held += len(text or "") + 100
                if held > TEXTS:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)

    return mapped(docs, run, EVENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("h", pa.int64()), ("m", pa.int64()), ("doc_id", pa.int64()), ("stretch", pa.int64()), ("kind", pa.int8()), ("at", pa.int64()), ("ids", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


SWEPT = "chunk long, h long, m long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own binary, pairs binary, counts binary"


class _Chunks:
    """Parts of documents' links on their way out: at a bounded number a chunk is closed, and its rows go out with the table of its different pairs."""

    def __init__(self) -> None:
        self.next, self.parts, self.size = TaskContext.get().partitionId() << 32, [], 0

    def add(self, key: tuple, about: tuple | None, pairs: np.ndarray) -> None:
        self.parts.append((key, about or (None,) * 5, pairs))
        self.size += len(pairs)

    def full(self) -> bool:
        return self.size >= LINKS or len(self.parts) >= PARTS

    def close(self) -> pa.RecordBatch:
        every = np.concatenate([p for _, _, p in self.parts])
        pairs, own, counts = np.unique(every, return_inverse=True, return_counts=True)
        ends = np.cumsum([0] + [len(p) for _, _, p in self.parts])
        own = own.astype(_narrow(len(pairs)))
        rows = [(self.next, *key, *about, own[a:b].tobytes(), None, None) for (key, about, _), a, b in zip(self.parts, ends, ends[1:], strict=False)]
        rows.append((self.next, *(None,) * 9, pairs.astype(np.int64).tobytes(), counts.astype(np.int64).tobytes()))
        self.next, self.parts, self.size = self.next + 1, [], 0
        names = [x.split()[0] for x in SWEPT.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in SWEPT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class _Open:
    """The document that the machine is in: what it has counted, the hash of its groups so far, and the tokens of its open group."""

    def __init__(self, key: tuple):
        self.key, self.n, self.hash, self.groups = key, [0, 0], hashlib.sha256(), 0
        self.ids, self.ends = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2

    def about(self) -> tuple:
        return (self.n[0], self.n[1], self.groups, self.groups, self.hash.hexdigest() if self.groups else "")


def _swept(events: DataFrame, files: list[bytes]) -> DataFrame:
    """Rows of ``SWEPT`` from events sorted by document, stretch and tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [tokenizer(x).pieces for x in files]
        lens = [np.array([len(p) for p in x], np.int64) for x in pieces]
        kinds = [_narrow(len(x)) for x in pieces]
        wide = len(pieces[1])
        most = max(map(len, pieces))
        words = np.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], object)
        chunks = _Chunks()
        last: _Open | None = None

        def sweep(rows: list[tuple], ended: bool) -> Iterator[pa.RecordBatch]:
            """Through rows of whole stretches; the last document stays open unless it has ended."""
            nonlocal last
            docs: list[_Open] = [last] if last else []
            ids: list[list] = [[d.ids[k] for d in docs] for k in (0, 1)]
            ends: list[list] = [[d.ends[k] for d in docs] for k in (0, 1)]
            owner: list[list] = [[np.zeros(len(d.ids[k]), np.int64) for d in docs] for k in (0, 1)]
            for h, m, doc_id, _, k, at, raw in rows:
                if not docs or docs[-1].key[:2] != (h, m):
                    docs.append(_Open((h, m, doc_id)))
                own = np.frombuffer(raw, kinds[k]).astype(np.int64)
                docs[-1].n[k] += len(own)
                ids[k].append(own)
                ends[k].append(at + np.cumsum(lens[k][own]))
                owner[k].append(np.full(len(own), len(docs) - 1))
            flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
            (ia, ib), (ea, eb), (oa, ob) = map(flat, ids), map(flat, ends), map(flat, owner)
            # documents one after the other on one line
            top = np.zeros((2, len(docs) + 1), np.int64)
            top[0][oa + 1], top[1][ob + 1] = ea, eb  # ends ascend, so a document's last one stays
            base = np.cumsum(top.max(0))
            ga, gb = ea + base[oa], eb + base[ob]
            shut = np.intersect1d(ga, gb, assume_unique=True)
            group_a, group_b = np.searchsorted(shut, ga), np.searchsorted(shut, gb)
            na, nb = (int(np.searchsorted(g, len(shut))) for g in (group_a, group_b))
            place_a, place_b = np.searchsorted(ga, shut), np.searchsorted(gb, shut)
            pairs = ia[place_a] * wide + ib[place_b]
            # the texts of the closed groups: A's tokens, then B's, group by group
            text = np.empty(na + nb, np.int64)
            text[np.arange(na) + np.append(0, place_b + 1)[group_a[:na]]] = ia[:na] + most * (ga[:na] == shut[group_a[:na]])
            text[np.arange(nb) + (place_a + 1)[group_b[:nb]]] = ib[:nb] + 2 * most * (gb[:nb] == shut[group_b[:nb]])
            words_of = words[text].tolist()
            first = np.searchsorted(shut, base[: len(docs)], "right")  # each document's first group
            bound = np.append(first, len(shut))
            chars = np.append(0, place_a + place_b + 2)
            for k, doc in enumerate(docs):
                a, b = int(bound[k]), int(bound[k + 1])
                if b > a:
                    doc.hash.update((";" if doc.groups else "").encode() + "".join(words_of[chars[a] : chars[b]])[:-1].encode())
                    doc.groups += b - a
                done = ended or k < len(docs) - 1
                chunks.add(doc.key, doc.about() if done else None, pairs[a:b])
                if chunks.full():
                    yield chunks.close()
            last = None
            if docs and not ended:
                last = docs[-1]
                last.ids, last.ends = [ia[na:], ib[nb:]], [ea[na:], eb[nb:]]

        held: list[tuple] = []
        tokens = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                # a stretch is whole once a row of another one comes
                if tokens > SLAB and row[:2] + row[3:4] != held[-1][:2] + held[-1][3:4]:
                    yield from sweep(held, held[-1][:2] != row[:2])
                    held, tokens = [], 0
                held.append(row)
                tokens += len(row[-1])
        if held or last:
            yield from sweep(held, True)
        if chunks.parts:
            yield chunks.close()

    return mapped(events, run, SWEPT)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "counts")), strict=True):
            pair = np.frombuffer(pairs, np.int64)
            yield pa.RecordBatch.from_pydict({"chunk": np.full(len(pair), chunk), "pair": pair, "n": np.frombuffer(counts, np.int64)})


def _looked_up(parts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The sums over a chunk's links of each part, by the chunk's table of pairs."""
    known = known.sort_values("pair")
    count, best = known["count"].to_numpy(np.int64), known["best"].to_numpy(bool)
    own = [np.frombuffer(x, _narrow(len(known))) for x in parts.own]
    return pd.DataFrame({"h": parts.h, "m": parts.m, "n_best": [int(best[x].sum()) for x in own], "count_sum": [int(count[x].sum()) for x in own]})


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    Tokens of space + text by two tokenizer files, a byte-level BPE (JSON) or a sentencepiece
    model each; strings of special tokens are plain text. Offsets where tokens of both end cut the
    tokens into groups; the two tokens that end there are a link. n_best: links whose pair is the
    most frequent of its second id over all rows, ties included; count_sum: the sum over links of
    how often their pair is linked over all rows. groups_sha256: hash of the groups as
    ``a1,a2|b1;a3|b2``.

    Texts that are null or empty, or whose tokens of either tokenizer don't give back their bytes,
    have no tokens: zeros and an empty string. Repeated rows count each. Other columns are not read.
    """
    files = [_read(p) for p in (path_a, path_b)]
    for raw in files:
        tokenizer(raw)  # a file of another kind fails here and not in tasks
    wide = len(tokenizer(files[1]).pieces)
    few = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    events = _events(few.withColumn("h", F.xxhash64("doc_id", "text")), files)
    ordered = events.repartition(fanout(docs), "h").sortWithinPartitions("h", "m", "stretch", "kind")
    swept = written(_swept(ordered, files))
    pairs = swept.where(F.col("pairs").isNotNull()).select("chunk", "pairs", "counts").mapInArrow(_unpacked, "chunk long, pair long, n long")
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % wide)
    highest = totals.groupBy("b").agg(F.max("count").alias("highest"))
    known = pairs.join(totals.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pair").select("chunk", "pair", "count", "best")
    about = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    parts = swept.where(F.col("pairs").isNull())
    sums = parts.select("chunk", "h", "m", "own").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(_looked_up, "h long, m long, n_best long, count_sum long")
    ends = parts.where(F.col("n_a").isNotNull()).select("h", "m", *about)
    whole = ends.unionByName(sums, allowMissingColumns=True).groupBy("h", "m").agg(*(F.max(c).alias(c) for c in about), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return whole.select(F.col("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
