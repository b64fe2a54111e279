"""Benchmark decontamination: BM25 over test items, every training passage a query, block-max WAND.

Test items (long ones in segments) make an inverted index whose weights are each segment's
BM25 weights over its own full score, so one threshold fits all. Every training text is cut
into overlapping passages, each a query. The block maxima of its rare terms, plus
the most that common terms add to a segment of the block, bound what a segment can score; only passages with a block
over the threshold run WAND, which skips by the same maxima and returns all segments at or
above the threshold. A hit is verified on word triples of the item's question and its answer.

The index goes to the executors in blocks of items of at most ``index_bytes`` of text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .exchange import any_names, mapped, others
from .wordarrays import chunks, mix64, spans, text_buffer

PASSAGE, SEGMENT, THRESHOLD, OVERLAP, INDEX_BYTES = 128, 48, 0.5, 0.5, 16 << 20
K1, B, BLOCK, COMMON = 1.2, 0.75, 2, 0.05
_U = np.uint64
#: ASCII bytes that are no letter or digit end a word; so "end." and "end" are the same.
_BREAK = np.zeros(256, bool)
_BREAK[:128] = [not chr(b).isalnum() for b in range(128)]


def _triples(tokens: np.ndarray) -> np.ndarray:
    if len(tokens) < 3:
        return tokens
    with np.errstate(over="ignore"):
        return mix64(tokens[:-2] * _U(0x9E3779B97F4A7C15) + tokens[1:-1] * _U(0xC2B2AE3D27D4EB4F) + tokens[2:] * _U(0x165667B19E3779F9))


class Index:
    """BM25 postings of the segments of some items, with maxima by term and by block."""

    def __init__(self, ids: list, texts: list[str | None], passage: int = PASSAGE, segment: int = SEGMENT):
        self.ids, self.passage = ids, passage
        data, off = text_buffer(pa.array(texts, pa.string()))
        words = spans(data, off, _BREAK)
        tokens = words.hashes(fold=True)
        self.parts, of, rows, terms = [], [], [], []
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            own = tokens[a:b]
            answer = max(1, len(own) // 3) if len(own) else 0
            self.parts.append(tuple(np.unique(_triples(x)) for x in (own[: len(own) - answer], own[len(own) - answer :])))
            for k in range(0, max(len(own) - segment // 2, min(len(own), 1)), segment):
                piece = own[k : k + segment] if k + segment + segment // 2 <= len(own) else own[k:]
                rows.append(np.full(len(piece), len(of)))
                terms.append(piece)
                of.append(i)
        self.item = np.array(of, np.int64)
        n = self.n = len(of)
        rows, terms = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*terms, np.zeros(0, _U)])
        self.vocabulary, term = np.unique(terms, return_inverse=True)
        pair, self.tf = np.unique(term * max(n, 1) + rows, return_counts=True)
        self.post_term, self.post_row = np.divmod(pair, max(n, 1))
        self.bound = np.searchsorted(self.post_term, np.arange(len(self.vocabulary) + 1))
        self.df = np.bincount(self.post_term, minlength=len(self.vocabulary))
        self.length = np.bincount(rows, minlength=n)
        self.weigh(n, self.df, self.length.mean() if n else 1.0)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.vocabulary & _U(0xFFFF)).astype(np.int64)] = True

    def weigh(self, of_all: int, df: np.ndarray, mean: float) -> None:
        """Weights and maxima, by the number of segments of all blocks, in how many of them each term of this one stands, and their mean length."""
        n = self.n
        idf = np.log(1 + (of_all - df + 0.5) / (df + 0.5))
        weight = idf[self.post_term] * self.tf * (K1 + 1) / (self.tf + K1 * (1 - B + B * self.length[self.post_row] / max(mean, 1)))
        self.weight = weight / np.bincount(self.post_row, weight, minlength=n)[self.post_row] if n else weight
        self.most = np.maximum.reduceat(self.weight, self.bound[:-1]) if n else np.zeros(0)
        self.common = df > max(2, COMMON * of_all)
        key = self.post_term * (n // BLOCK + 1) + self.post_row // BLOCK
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.zeros(0, np.int64)
        self.block_most = np.maximum.reduceat(self.weight, head) if n else np.zeros(0)
        self.block_of, self.blocks = self.post_row[head] // BLOCK, n // BLOCK + 1
        self.block_bound = np.searchsorted(self.post_term[head], np.arange(len(self.vocabulary) + 1))
        common = self.common[self.post_term]  # what common terms can add in a block, whatever the query
        of_row = np.bincount(self.post_row[common], self.weight[common], minlength=self.blocks * BLOCK)
        self.block_common = of_row.reshape(self.blocks, BLOCK).max(1)

    def wand(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All (segment, score) at or above the threshold for a query of distinct terms, by block-max WAND."""
        lists = [[self.post_row[a:b], self.weight[a:b], 0, float(self.most[t]), dict(zip(self.block_of[c:d].tolist(), self.block_most[c:d].tolist(), strict=True))] for t in terms for a, b, c, d in [(self.bound[t], self.bound[t + 1], self.block_bound[t], self.block_bound[t + 1])]]
        found = []
        while lists:
            lists.sort(key=lambda x: x[0][x[2]])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[3]
                if total >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            row = lists[pivot][0][lists[pivot][2]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]] == row:
                pivot += 1
            block = int(row) // BLOCK
            if sum(x[4].get(block, 0.0) for x in lists[: pivot + 1]) < threshold - 1e-9:
                # no segment up to the block's end, or the next list's place, can reach it
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, int(lists[pivot + 1][0][lists[pivot + 1][2]]))
                moved, to = lists[: pivot + 1], max(to, int(row) + 1)
            elif lists[0][0][lists[0][2]] == row:
                score = sum(float(x[1][x[2]]) for x in lists[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((int(row), score))
                moved, to = lists[: pivot + 1], int(row) + 1
            else:
                moved, to = [x for x in lists[:pivot] if x[0][x[2]] < row], int(row)
            for x in moved:
                x[2] += int(np.searchsorted(x[0][x[2] :], to))
            lists = [x for x in lists if x[2] < len(x[0])]
        return found

    def matches(self, texts: pa.Array, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of verified hits, the best of each text and item."""
        if not self.n:
            return
        half = self.passage // 2
        for low, _, data, off in chunks(texts):
            words = spans(data, off, _BREAK)
            tokens = words.hashes(fold=True)
            hit = np.flatnonzero(self.filter[(tokens & _U(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, tokens[hit]), len(self.vocabulary) - 1)
            ok = self.vocabulary[at] == tokens[hit]
            hit, term = hit[ok], at[ok]
            text = np.searchsorted(words.first, hit, "right") - 1
            n_passages = np.maximum(1, -(-(words.counts - half) // half))
            base = np.concatenate([[0], np.cumsum(n_passages)])
            k = (hit - words.first[text]) // half
            passage = np.concatenate([base[text] + k, base[text] + k - 1])
            fine = np.concatenate([k < n_passages[text], k > 0])
            code = np.unique(passage[fine] * len(self.vocabulary) + np.concatenate([term, term])[fine])
            passage, term = np.divmod(code, len(self.vocabulary))
            rare = ~self.common[term]
            p, t = passage[rare], term[rare]
            count = self.block_bound[t + 1] - self.block_bound[t]
            flat = np.arange(count.sum()) + np.repeat(self.block_bound[t] - (np.cumsum(count) - count), count)
            key, where = np.unique(np.repeat(p, count) * self.blocks + self.block_of[flat], return_inverse=True)
            top = np.bincount(where, self.block_most[flat], minlength=len(key))
            open_ = np.unique(key[top + self.block_common[key % self.blocks] >= threshold - 1e-9] // self.blocks)
            if (self.block_common >= threshold - 1e-9).any():  # an item of common terms alone: then every passage is a query
                open_ = np.unique(passage)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for q in open_:
                a, b = np.searchsorted(passage, [q, q + 1])
                for segment, score in self.wand(term[a:b], threshold):
                    i = int(self.item[segment])
                    d = int(np.searchsorted(base, q, "right")) - 1
                    start = words.first[d] + (q - base[d]) * half
                    reach = max(self.passage, sum(map(len, self.parts[i])))
                    region = tokens[max(words.first[d], start - reach) : min(words.first[d + 1], start + self.passage + reach)]
                    seen = _triples(region)
                    question, answer = (float(np.isin(x, seen if len(x) and len(region) >= 3 else region).mean()) if len(x) else 1.0 for x in self.parts[i])
                    if question >= overlap and answer >= overlap:
                        best[d, i] = max(best.get((d, i), (0.0, 0.0, 0.0)), (score, question, answer))
            for (d, i), found in sorted(best.items()):
                yield low + d, i, *found


def indexes(benchmark: DataFrame, item: str, text: str, index_bytes: int) -> list[Index]:
    """Indexes of blocks of items, each collected by itself and bounded in size; most benchmarks are one block.

    All weigh their terms by the counts over all items, so that scores don't follow the blocks.
    """
    rows = benchmark.select(F.col(item).alias("id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / index_bytes))
    out = []
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        got = sorted(part.collect(), key=lambda r: (str(r.id), r.text or ""))
        out.append(Index([r.id for r in got], [r.text for r in got]))
    if n > 1:
        vocabulary, at = np.unique(np.concatenate([x.vocabulary for x in out]), return_inverse=True)
        df = np.bincount(at, np.concatenate([x.df for x in out]), len(vocabulary))
        segments, length = sum(x.n for x in out), sum(int(x.length.sum()) for x in out)
        for x in out:
            x.weigh(segments, df[np.searchsorted(vocabulary, x.vocabulary)], length / max(segments, 1))
    return out


@any_names
def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs without the text, for each item that a text holds, with item, score, question_overlap and answer_overlap.

    score: the BM25 score of the best passage over the item's own, 1 where all its words stand
    together. Null and empty texts and items have no match. Equal rows each get their matches,
    as do items of one id or text. Long texts are cut into passages. Without rows or items the
    result is empty. Columns of docs named like the new ones, whatever their case, are replaced.
    """
    new = [item, "score", "question_overlap", "answer_overlap"]
    rest = others(docs, [text, *new])
    kind = benchmark.schema[item].dataType
    source = docs.select(F.col(text).cast("string").alias(f"{text} of docs"), *rest)
    schema = StructType([*source.schema.fields[1:]]).add(item, kind).add("score", "double").add("question_overlap", "double").add("answer_overlap", "double")
    out = None
    for index in indexes(benchmark, item, item_text, index_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(index.matches(batch.column(0), threshold, overlap))
                if found:
                    row, i, *numbers = zip(*found, strict=True)
                    kept = batch.take(pa.array(row))
                    own = pa.array([index.ids[x] for x in i])
                    yield pa.RecordBatch.from_arrays([*kept.columns[1:], own, *(pa.array(x, pa.float64()) for x in numbers)], [*rest, *new])

        part = source.transform(mapped, run, schema)
        out = part if out is None else out.unionByName(part)
    return out


@any_names
def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs whose text holds no item, with their columns; null and empty texts stay, equal rows share their fate."""
    at = [c.lower() for c in docs.columns].index(text.lower())
    for index in indexes(benchmark, item, item_text, index_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in index.matches(batch.column(at).cast(pa.string()), threshold, overlap)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.transform(mapped, run, docs.schema)
    return docs
