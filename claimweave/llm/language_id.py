"""Language ID: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal.

Code-point n-grams of 1 to 3 characters of the lower-cased text hash into ``dim`` features.
Document frequencies are counted in Spark over all training documents. Weights are fitted on
the driver on at most ``sample`` different labelled texts, as many of each language as far as
they go and one at least, with FTRL-proximal steps and elastic-net penalties, whose first part leaves most weights at zero.
A fifth of the sample is held out to fit the temperature.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .exchange import any_names, mapped, others

DIM, SAMPLE, EPOCHS = 1 << 13, 2000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def counts(text: str, dim: int = DIM) -> np.ndarray:
    """How often each hashed n-gram stands in the text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c[(c >= 9) & (c <= 13)] = 32
    two = c[:-1] * np.uint64(2654435761) + c[1:] * np.uint64(40503) + np.uint64(7919)
    three = two[:-1] * np.uint64(2246822519) + c[2:] * np.uint64(3266489917)
    grams = np.concatenate([c * np.uint64(668265263), two, three])
    return np.bincount(((grams >> np.uint64(7)) ^ grams) % np.uint64(dim), minlength=dim)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (dim + 1, languages); the last row is the bias
    temperature: float = 1.0

    def vector(self, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf
        return np.append(x / max(np.sqrt(x @ x), 1e-12), 1.0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights) / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)


def fit(langs: list[str], idf: np.ndarray, rows: Iterable[tuple[int, np.ndarray]]) -> Model:
    """FTRL-proximal over the rows (language, n-gram counts), with a temperature from every fifth."""
    model = Model(langs, idf, np.zeros((len(idf) + 1, len(langs))))
    data = []
    for y, n in rows:
        x = model.vector(n)
        at = np.flatnonzero(x)
        data.append((y, at, x[at].astype(np.float32)))
    often = Counter(d[0] for d in data)
    held = [d for i, d in enumerate(data) if not i % 5 and often[d[0]] >= 5]
    train = [d for i, d in enumerate(data) if i % 5 or often[d[0]] < 5]
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for _ in range(EPOCHS):
        for y, at, x in train or data:
            v = x[:, None].astype(float)
            w = np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
            s = (v * w).sum(0)
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = v * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    model.weights = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    if held:
        y = np.array([d[0] for d in held])
        logits = np.stack([x @ model.weights[at] for _, at, x in held])

        def loss(t: float) -> float:
            e = np.exp((logits - logits.max(-1, keepdims=True)) / t)
            return -np.log(np.maximum((e / e.sum(-1, keepdims=True))[np.arange(len(y)), y], 1e-12)).mean()

        model.temperature = float(min(np.exp(np.linspace(-3, 2, 61)), key=loss))
    return model


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE, dim: int = DIM) -> Model:
    """A model of the languages of those rows for which learn is true and text and lang are not null."""
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(dim, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                total += counts(value.as_py(), dim) > 0
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim)), pa.array(np.append(rows, total))], ["feature", "n"])

    df = np.zeros(dim + 1)
    for feature, n in known.select("text").transform(mapped, frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n")).toLocalIterator():
        df[feature + 1] = n

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, h, value in zip(*batch.columns, strict=True):
                n = counts(value.as_py(), dim).astype("<u4")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([y.as_py()], pa.string()), "h": [h.as_py()], "at": [at.astype("<u4").tobytes()], "n": [n[at].tobytes()]})

    hashed = known.withColumn("_x", F.xxhash64("text"))
    texts = {r.lang: r.n for r in hashed.groupBy("lang").agg(F.approx_count_distinct("_x", 0.02).alias("n")).collect()}
    langs = sorted(texts)
    quota = max(1, sample // max(len(langs), 1))
    rows = []
    if langs:
        wanted = 1.2 * quota + 4 * quota**0.5 + 10  # by hash, so that tasks send the driver little more than the sample
        shares = F.create_map(*[F.lit(x) for y in langs for x in (y, int(min(1.0, wanted / max(texts[y], 1)) * (1 << 30)))])
        drawn = hashed.withColumn("_h", F.pmod("_x", F.lit(1 << 30))).where(F.col("_h") <= shares[F.col("lang")])
        once = drawn.groupBy("lang", "_h", "_x").agg(F.min("text").alias("text")).select("lang", "_h", "text")
        found = sorted((r.lang, r.h, bytes(r.at), bytes(r.n)) for r in once.transform(mapped, features, "lang string, h long, at binary, n binary").collect())
        rows = [r for _, group in itertools.groupby(found, lambda r: r[0]) for r in itertools.islice(group, quota)]

    def dense(at: bytes, n: bytes) -> np.ndarray:
        out = np.zeros(dim)
        out[np.frombuffer(at, "<u4")] = np.frombuffer(n, "<u4")
        return out

    order = np.random.default_rng(5).permutation(len(rows))
    return fit(langs, np.log((df[0] + 1) / (df[1:] + 1)) + 1, ((langs.index(rows[i][0]), dense(*rows[i][2:])) for i in order))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the calibrated probability of it.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if the
    model has no language. Equal texts get equal results; long ones take memory in proportion
    to their length. Columns of docs named like the new ones, whatever their case, are replaced.
    """
    rest = others(docs, ("lang_pred", "score"))
    at = [c.lower() for c in rest].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            values = [(i, v) for i, v in enumerate(batch.column(at).cast(pa.string())) if model.langs and v.is_valid]
            for k in range(0, len(values), 256):
                block = [(i, t) for i, v in values[k : k + 256] if _LETTER.search(t := v.as_py())]
                if block:
                    p = model.probabilities(np.stack([model.vector(counts(t, len(model.idf))) for _, t in block]))
                    for (i, _), row in zip(block, p, strict=True):
                        names[i], scores[i] = model.langs[row.argmax()], row.max()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*rest, "lang_pred", "score"])

    source = docs.select(*rest)
    return source.transform(mapped, run, StructType([*source.schema.fields]).add("lang_pred", "string").add("score", "double"))


def held_out(id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no rest; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds == 0


@any_names
def language_id(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, lang_pred and score; learnt from the rows that are not held out.

    Rows of null text or language teach nothing; a null id counts as an empty text, and repeated
    ids as what they are. An empty table gives an empty result.
    """
    model = train(docs, ~held_out(id, folds), text, lang, sample)
    rest = others(docs, ("held_out", "lang_pred", "score"))
    return predict(docs.select(*rest, held_out(id, folds).alias("held_out")), model, text)
