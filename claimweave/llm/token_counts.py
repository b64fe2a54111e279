"""Token counts of a public tokenizer, without its tokens: one pass of dynamic programming over vocabulary matches.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character. For each
position the programme carries the number of pieces of the text up to there, and what its
tokenizer's rule needs to choose among the matches:

- unigram vocabularies (``Viterbi``): the best score, in 32-bit sums; of equal scores the
  longer last piece wins. Characters without a piece are unknown, at ten below the lowest score.
- merge vocabularies (``Merges``): the last piece. Merging by rank gives exactly one last piece
  to each beginning of a text: that match which stays apart from the piece before it when the
  two are merged as one text. Whether two pieces stay apart is kept in a bounded table.

Control, unknown and byte pieces match no text. A character without a piece counts as its
UTF-8 bytes where the vocabulary has byte pieces; else a run of them counts as one. Spaces
become the word mark, and one goes before the text. As no piece has a mark after another
character, none reaches from word to word, so words are looked up in a bounded table of
counts; runs of marks belong to the word after them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .exchange import any_names, mapped, others

MARK, UNKNOWN_PENALTY, MOST_WORDS, MOST_PAIRS = "▁", 10.0, 300_000, 1_000_000
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@dataclass
class Vocabulary:
    """Pieces of text with their scores, whether they merge by rank, and whether bytes stand for unknown characters."""

    pieces: list[tuple[str, float]]
    merges: bool = False
    bytes: bool = False
    marks_first: bool = True  # a mark goes before each text

    #: Fixed value: the numbers of model kinds and piece kinds in a model file.
    KINDS = {"merges": 2, "text": 1, "own": 4, "byte": 6}  # noqa: RUF012


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece model file of either kind that leaves texts as they are."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = Vocabulary.KINDS
    if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or any(p.type == kinds["own"] for p in model.pieces):
        raise ValueError(f"{path}: only vocabularies without normalisation and user-defined pieces")
    pieces = [(p.piece, p.score) for p in model.pieces if p.type == kinds["text"]]
    has_bytes = sum(p.type == kinds["byte"] for p in model.pieces) == 256
    return Vocabulary(pieces, model.trainer_spec.model_type == kinds["merges"], has_bytes, model.normalizer_spec.add_dummy_prefix)


def counter(vocabulary: Vocabulary) -> Counter:
    return (Merges if vocabulary.merges else Viterbi)(vocabulary)


@lru_cache(2)
def _counter(path: str) -> Counter:
    """The counter of a file, with the words that earlier tasks of this process counted."""
    return counter(read_vocabulary(path))


@dataclass
class Counter:
    """Counts of words, kept up to a bound. A subclass says how a run of characters is counted."""

    vocabulary: Vocabulary
    words: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.pieces = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(self.vocabulary.pieces):
            if piece:
                self.pieces.add_word(piece, (len(piece), score, k))
        self.pieces.make_automaton()
        self.across = any(MARK in p.lstrip(MARK) for p, _ in self.vocabulary.pieces)

    def unknown(self, char: str, again: bool) -> int:
        """Pieces that a character without one adds."""
        return len(char.encode("utf-8", "surrogatepass")) if self.vocabulary.bytes else 0 if again else 1

    def count(self, run: str) -> int:
        raise NotImplementedError

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.count(word)
            if len(word) < 64:
                if len(self.words) >= MOST_WORDS:
                    self.words.clear()
                self.words[word] = n
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        marked = MARK + marked if self.vocabulary.marks_first else marked
        return self.count(marked) if self.across else sum(map(self.word, _WORD.findall(marked)))


class Viterbi(Counter):
    """The best path by the sum of scores; of equal sums the one with the longer last piece."""

    def count(self, run: str) -> int:
        lowest = np.float32(min((s for _, s in self.vocabulary.pieces), default=0.0)) - np.float32(UNKNOWN_PENALTY)
        best, pieces, was_unknown = [np.float32(0)], [0], [False]
        found = self.pieces.iter(run)
        end, hit = next(found, (-1, None))
        for at, char in enumerate(run):
            top, n, single, unknown = None, 0, False, False
            while end == at:  # longest first
                size, score, _ = hit
                single |= size == 1
                total = best[at + 1 - size] + np.float32(score)
                if top is None or total > top:
                    top, n = total, pieces[at + 1 - size] + 1
                end, hit = next(found, (-1, None))
            if not single and (top is None or best[at] + lowest > top):
                top, unknown = best[at] + lowest, True
                n = pieces[at] + self.unknown(char, was_unknown[at])
            best.append(top)
            pieces.append(n)
            was_unknown.append(unknown)
        return pieces[-1]


class Merges(Counter):
    """The path of merging by rank, the highest score first and of equal ones the leftmost."""

    def __post_init__(self) -> None:
        super().__post_init__()
        self.rank = dict(self.vocabulary.pieces)
        self.reached = [self.merged(p) == [p] for p, _ in self.vocabulary.pieces]
        self.apart: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            options = [(-self.rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.rank]
            if not options:
                break
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stays(self, a: int, b: int) -> bool:
        """Whether two pieces, side by side, are what merging makes of their text."""
        known = self.apart.get((a, b))
        if known is None:
            x, y = self.vocabulary.pieces[a][0], self.vocabulary.pieces[b][0]
            known = self.merged(x + y) == [x, y]
            if len(self.apart) >= MOST_PAIRS:
                self.apart.clear()
            self.apart[a, b] = known
        return known

    def count(self, run: str) -> int:
        last: list[int | None] = [None]
        pieces, was_unknown = [0], [False]
        found = self.pieces.iter(run)
        end, hit = next(found, (-1, None))
        for at, char in enumerate(run):
            own, n = None, 0
            while end == at:
                size, _, k = hit
                start = at + 1 - size
                if own is None and self.reached[k] and (last[start] is None or self.stays(last[start], k)):
                    own, n = k, pieces[start] + 1
                end, hit = next(found, (-1, None))
            if own is None:  # nothing merges with it, so what follows begins anew
                n = pieces[at] + self.unknown(char, was_unknown[at])
            last.append(own)
            pieces.append(n)
            was_unknown.append(own is None)
        return pieces[-1]


@any_names
def token_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with n_tokens of each text; vocabulary is the path of a model file that all executors have.

    Null and empty texts have 0. Long texts take time and memory in proportion to their length.
    Equal rows get equal results; ids are not read. A column of docs of the new name, whatever
    its case, is replaced. An empty table gives an empty result.
    """
    rest = others(docs, ("n_tokens",))
    source = docs.select(*rest)
    at = [c.lower() for c in rest].index(text.lower())
    return source.transform(mapped, partial(_count, path=vocabulary, at=at, names=[*rest, "n_tokens"]), StructType([*source.schema.fields]).add("n_tokens", "long"))


def _count(batches: Iterator[pa.RecordBatch], path: str, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    own = _counter(path)
    for batch in batches:
        n = np.array([own.text(v.as_py()) for v in batch.column(at).cast(pa.string())], np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names)


@any_names
def with_bytes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long"))
