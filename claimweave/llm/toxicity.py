"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton on folded text.

Folding lower-cases, and maps homoglyphs and digits to the letters they stand for. The lexicon
has whole words and word beginnings, weighted by the log ratio of the document frequencies in
toxic and other documents of a sample of labelled rows, bounded by a parameter. A hit inside
an exception phrase doesn't count. The hits' weight, as it is and by length, goes through a
logistic curve fitted on the same sample.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .exchange import any_names, mapped, others
from .language_id import held_out

SAMPLE, MOST_TERMS, LEAST_DOCS, LEAST_WEIGHT = 4000, 2000, 4, 2.0
#: Letters that look like others, and digits used for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "т": "t", "к": "k", "м": "m", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "α": "a", "ο": "o", "ρ": "p", "ι": "i", "ν": "v", "ε": "e", "τ": "t", "κ": "k", "в": "b", "н": "h", "ѵ": "v", "ԛ": "q", "ԝ": "w", "һ": "h", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Characters without width, and the soft hyphen.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "loser bracket", "pond scum")
_FULL_WIDTH = {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
_FOLD = {ord(a): b for a, b in (HOMOGLYPHS | DIGITS).items()} | _FULL_WIDTH | {ord(c): None for c in UNSEEN}
_WORD, _LONGEST = re.compile(r"\w+"), 1 << 10


def fold(text: str) -> str:
    """Lower case, homoglyphs, full-width letters and digits as plain letters, and nothing unseen between them."""
    return text.lower().translate(_FOLD)


def _inside(p: int, ranges: list[tuple[int, int]]) -> bool:
    """Whether a place lies in one of the ranges, which stand in the order of their ends and are no longer than the longest phrase."""
    k = bisect_left(ranges, p, key=lambda r: r[1])
    while k < len(ranges) and ranges[k][1] - p < _LONGEST:
        if ranges[k][0] <= p:
            return True
        k += 1
    return False


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # a word, or a beginning with "*" behind it
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-2.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        terms: dict[str, list] = {}
        for term, w in self.weights.items():
            terms.setdefault(term.rstrip("*"), []).append((term.endswith("*"), w))
        for phrase in self.exceptions:
            terms.setdefault(fold(phrase), []).append((None, 0.0))
        for term, kinds in terms.items():
            found.add_word(term, (len(term), kinds))
        if terms:
            found.make_automaton()
        return found

    def features(self, text: str, found: ahocorasick.Automaton) -> tuple[float, float]:
        """The hits' weight and that weight by thousand words, both as log1p. Of a word's hits the heaviest counts."""
        folded = fold(text)
        hits: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        if len(found):
            for end, (size, kinds) in found.iter(folded):
                start = end - size + 1
                if start and (folded[start - 1].isalnum() or folded[start - 1] == "_"):
                    continue
                ends = end + 1 == len(folded) or not (folded[end + 1].isalnum() or folded[end + 1] == "_")
                for prefix, w in kinds:
                    if prefix is None and ends:
                        safe.append((start, end))
                    elif prefix or (prefix is False and ends):
                        hits[start] = max(hits.get(start, 0.0), w)
        total = sum(w for p, w in hits.items() if not _inside(p, safe)) if safe else sum(hits.values())
        if not total:
            return 0.0, 0.0
        return np.log1p(total), np.log1p(1000.0 * total / (len(text.split()) + 20.0))

    def score(self, x: tuple[float, float]) -> float:
        return 1.0 / (1.0 + np.exp(-np.clip(self.curve[0] + self.curve[1] * x[0] + self.curve[2] * x[1], -30, 30)))


def terms(text: str) -> set[str]:
    """The words of a text and their beginnings of 4 to 8 letters, folded."""
    words = set(_WORD.findall(fold(text)))
    return words | {w[:k] + "*" for w in words for k in range(4, min(9, len(w)))}


def learn(rows: list[tuple[str, int]], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon of a bounded list of (text, toxic)."""
    rows = sorted(rows)
    totals, seen = [0, 0], {}
    for text, y in rows:
        totals[y] += 1
        for t in terms(text):
            seen.setdefault(t, [0, 0])[y] += 1
    ratio = {t: np.log((n[1] + 0.5) / (totals[1] + 1)) - np.log((n[0] + 0.5) / (totals[0] + 1)) for t, n in seen.items() if n[1] >= LEAST_DOCS}
    best = sorted((t for t, w in ratio.items() if w >= LEAST_WEIGHT), key=lambda t: (-ratio[t] * np.sqrt(seen[t][1]), t))[:MOST_TERMS]
    out = Lexicon({t: float(ratio[t]) for t in best}, exceptions)
    if rows and all(totals):
        found = out.automaton()
        x = np.array([(1.0, *out.features(t, found)) for t, _ in rows])
        y = np.array([y for _, y in rows], float)
        w = np.zeros(3)
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * w)
        out.curve = tuple(float(v) for v in w)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, learnable: Column, id: str, text: str, sample: int) -> list[tuple[str, int]]:
    """At most ``sample`` texts of labelled rows that may be learnt from, half of each label; the drawn labels, bounded by it, are broadcast to the documents. Of texts with one id the smallest counts."""
    own = labels.where(learnable & F.col("toxic").isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col("toxic").cast("int").alias("_toxic")).distinct()
    draw = [own.where(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2) for y in (0, 1)]
    drawn = F.broadcast(draw[0].unionByName(draw[1]))
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text")).join(drawn, "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).collect()
    return [(r._text or "", r._toxic) for r in rows]


@any_names
def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Labels come from rows that are not held out. Null and empty texts have no hit and get the
    curve's lowest score; so does every text where no label can be learnt from. Equal texts get
    equal results; long ones take memory in proportion to their length. A null id has no label.
    Columns of docs named like the new ones, whatever their case, are replaced. An empty table
    gives an empty result.
    """
    lexicon = learn(labelled_sample(docs, labels, ~held_out(id, folds), id, text, sample))
    rest = others(docs, ("held_out", "score", "predicted"))
    at = [c.lower() for c in rest].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lexicon.automaton()
        for batch in batches:
            score = np.array([lexicon.score(lexicon.features(v.as_py() or "", found)) for v in batch.column(at).cast(pa.string())], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*rest, "held_out", "score", "predicted"])

    source = docs.select(*rest).withColumn("held_out", held_out(id, folds))
    return source.transform(mapped, run, StructType([*source.schema.fields]).add("score", "double").add("predicted", "integer"))
