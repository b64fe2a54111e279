"""LM scoring: a causal self-attention model on subword ids, trained and run in numpy.

Words (A-Z lowered) become subword ids of a public tokenizer's file; a text is the ids of its
words and one end. The model has one attention head over windows of ``LENGTH`` ids; windows
overlap, and each id is scored once, with at least LENGTH - STEP ids before it in its window
where the text has as many. It predicts in two steps one of ``GROUPS`` groups of ids and one of
the group's ``MEMBERS`` classes, all of about equal frequency, word beginnings apart from other
ids; most classes are one id, and within a class ids follow their smoothed frequency.

Texts are split into ids once and kept packed. Each id is counted over all training texts.
Weights start from a sample of training texts bounded by a parameter and are then trained in
rounds on all windows of all training texts, each window and id once. A shard has some ``SHARD``
windows, a task trains on those of one shard and round, and the shards' weights are averaged.

The base score needs each word's count over all training texts. The distinct words of a chunk
of texts, the end among them, go packed to reducers by hash with their counts in the chunk; a
reducer adds them up and tells each chunk the sums. So the most frequent word sends its reducer
one number for each chunk. Each text's words are kept as indices into its chunk's words, and
chunks meet their sums in a second shuffle; no table of counts is joined or broadcast.
"""

from __future__ import annotations

import base64
import itertools
import math
import secrets
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import PACKED, PARTS, Unpacked, dealt, fanout, mapped, pack, planes, shuffles_freed, spread, unplanes, written
from .language_id import held_out
from .wordarrays import LOWER, chunks, mix64, spans

LENGTH, STEP, WIDTH, GROUPS, MEMBERS, INPUTS, SAMPLE, STEPS, BATCH = 32, 24, 16, 64, 64, 4096, 1500, 900, 1024
SHARD, ROUNDS, RATE, FIRST_RATE = 1 << 17, 4, 0.002, 0.02
ROWS, WINDOWS, MOST_KNOWN = 1024, 64, 400_000  # what is worked on at once, so that it stays in the processor's cache, and how many split words a process keeps; results don't follow them
_END = np.uint64(0x5851F42D4C957F2D)  # the end's hash beside the words'
_U = np.uint64
#: Fixed value: how the public byte-level tokenizers split a text before they merge bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _tokenizer(path: str) -> tuple:
    """The tokenizer of a file of ranks, and for each id whether it begins with a space."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    spaced = np.zeros(max(ranks.values()) + 1, bool)
    spaced[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), spaced


@dataclass
class Known:
    """The words that this process has split, by ascending hash: where each one's ids begin in ``ids``, and how many they are. A cache: beyond ``MOST_KNOWN`` words it begins anew."""

    hashes: np.ndarray
    begin: np.ndarray
    n: np.ndarray
    ids: np.ndarray

    def clear(self) -> None:
        for name, kept in vars(self).items():
            setattr(self, name, kept[:0].copy())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where these are or would be, and which are here."""
        at = np.searchsorted(self.hashes, hashes)
        return at, np.append(self.hashes, _U(0))[at] == hashes if len(self.hashes) else np.zeros(len(at), bool)

    def add(self, hashes: np.ndarray, at: np.ndarray, begin: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        self.hashes, self.n = np.insert(self.hashes, at, hashes), np.insert(self.n, at, n)
        self.begin = np.insert(self.begin, at, begin + len(self.ids))
        self.ids = np.concatenate([self.ids, ids])


@lru_cache(2)
def _known(path: str) -> Known:
    return Known(np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3)))


@dataclass
class Chunk:
    """Texts low to high of a batch: ids, those of each text from first[i] on, without ends; and the distinct words' hashes, ascending, and for each text's words, from at[i] on, which of them they are."""

    low: int
    high: int
    ids: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    which: np.ndarray
    at: np.ndarray


def subwords(path: str, texts: pa.Array, size: int = 2 << 20) -> Iterator[Chunk]:
    """The distinct words of a chunk that the process hasn't split yet are split in one call, each after one space. No word has a space inside, so the ids that begin with one are those that begin a word."""
    tokenizer, spaced = _tokenizer(path)
    known = _known(path)
    for low, high, data, off in chunks(texts, size):
        words = spans(data, off)
        hashes, first, which = np.unique(words.hashes(fold=True), return_index=True, return_inverse=True)
        if len(known.hashes) > MOST_KNOWN:
            known.clear()
        at, here = known.find(hashes)
        new = first[~here]
        raw = LOWER[data].tobytes()
        distinct = b"".join([b" " + raw[a:b] for a, b in zip(words.starts[new].tolist(), words.ends[new].tolist(), strict=True)])
        flat = tokenizer.encode_to_numpy(distinct.decode("utf-8", "replace"), disallowed_special=()).astype(np.int64)
        begin = np.flatnonzero(spaced[flat])
        known.add(hashes[~here], at[~here], begin, np.diff(np.append(begin, len(flat))), flat)
        at, _ = known.find(hashes)
        count = known.n[at][which]
        ends = np.cumsum(count)
        ids = known.ids[np.arange(count.sum()) + np.repeat(known.begin[at][which] - (ends - count), count)]
        yield Chunk(low, high, ids, np.concatenate([[0], ends])[words.first], hashes, which, words.first)


def _exp_sums(x: np.ndarray) -> np.ndarray:
    """x becomes its exponentials, in place; their sums along the last axis. Logits over 60 count as 60, so that no sum leaves the range of 32-bit floats; trained ones are far below."""
    if x.size and x.max() > 60:
        np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[-1], x.dtype)


def _by_group(g: np.ndarray, groups: int) -> tuple[np.ndarray, list[int]]:
    """An order of rows by their groups, and where each group begins in it."""
    order = np.argsort(g.astype(np.uint16), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(g, minlength=groups))]).tolist()


def _with_one(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows ``at`` of z with a last column of ones, which meets the biases."""
    out = np.ones((len(at), z.shape[1] + 1), z.dtype)
    out[:, :-1] = z[at]
    return out


def _of(x: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Each row's value in its column."""
    return x.reshape(-1)[np.arange(len(x)) * x.shape[1] + column]


@dataclass
class Attention:
    """One causal head with learnt positions, a residual, and a softmax over groups and over the classes of a group."""

    weights: dict[str, np.ndarray]
    class_of: np.ndarray  # group * members + the class within it
    log_within: np.ndarray  # log10 of the id's share of its class
    row_of: np.ndarray  # the id's input row: frequent ids have their own, others that of their group

    @classmethod
    def fresh(cls, class_of: np.ndarray, log_within: np.ndarray, row_of: np.ndarray, share: np.ndarray, width: int = WIDTH, seed: int = 3) -> Attention:
        """share: (groups, members), the classes' frequencies, from which the biases start."""
        r = np.random.default_rng(seed)
        g, m = share.shape
        shapes = {"E": (int(row_of.max()) + 2, width), "P": (LENGTH, width), "QKV": (width, 3 * width), "O": (width, width), "V": (width, g), "W": (g, width, m)}
        weights = {k: r.normal(0, 0.02 if k == "W" else width**-0.5, s) for k, s in shapes.items()}
        weights["b"], weights["c"] = np.log(share.sum(1)), np.log(share / share.sum(1, keepdims=True))
        return cls({k: w.astype(np.float32) for k, w in weights.items()}, class_of, log_within, row_of)

    @property
    def members(self) -> int:
        return self.weights["c"].shape[1]

    @cached_property
    def widths(self) -> np.ndarray:
        """How many classes of each group are looked at: those that some id has, up to a power of two. Most groups have few, the most frequent ids being a group each."""
        have = np.bincount(np.unique(self.class_of) // self.members, minlength=len(self.weights["b"]))
        return np.minimum(1 << np.ceil(np.log2(np.maximum(have, 1))).astype(np.int64), self.members)

    @cached_property
    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """The groups by their widths, and each group's place among them."""
        groups = np.argsort(self.widths, kind="stable")
        return groups, np.argsort(groups)

    def runs(self, bound: list[int]) -> Iterator[tuple[slice, int, list[tuple[int, slice]]]]:
        """Rows of groups of one width, as many as have some ``ROWS`` full rows of logits, so that one call serves several groups; the width; and these groups, each with its part of the rows.

        bound: where the rows of each group begin, in the order of widths. A group of one class needs nothing: it has the whole share.
        """
        run: list[tuple[int, slice]] = []
        first = high = last = 0
        for i, (low, end) in zip(self.ranked[0].tolist(), itertools.pairwise(bound), strict=True):
            width = int(self.widths[i])
            if low == end or width == 1:
                continue
            if run and (width != last or (end - first) * width > ROWS * self.members):
                yield slice(first, high), last, run
                run = []
            if not run:
                first, last = low, width
            run.append((i, slice(low - first, end - first)))
            high = end
        if run:
            yield slice(first, high), last, run

    def hidden(self, x: np.ndarray, skip: int = 0) -> tuple:
        """State after each position from ``skip`` on, for input rows x (batch, length); sums of attention divide its results, not the larger array of its weights."""
        w, (n, length) = self.weights, x.shape
        width = w["O"].shape[0]
        h = np.take(w["E"], x, axis=0)
        h += w["P"][:length]
        q, k, v = np.split((h.reshape(-1, width) @ w["QKV"]).reshape(n, length, -1), 3, axis=2)
        q = q[:, skip:] * np.float32(width**-0.5)
        s = q @ k.transpose(0, 2, 1)
        if s.size and s.max() > 60:  # so that no sum leaves the range of 32-bit floats; trained scores are far below
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= np.tri(length, dtype=np.float32)[skip:]
        part = (1 / (s.reshape(-1, length) @ np.ones(length, s.dtype))).reshape(n, length - skip, 1)
        a = s @ v
        a *= part
        z = (a.reshape(-1, width) @ w["O"]).reshape(a.shape)
        z += h[:, skip:]
        return z, (h, q, k, v, s, part, a)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of groups, and those of classes within each, with their biases as last rows."""
        w = self.weights
        return np.concatenate([w["V"], w["b"][None]]), np.concatenate([w["W"], w["c"][:, None]], axis=1)

    def log_probability(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logs of the classes y (n) after states z (n, width)."""
        upper, lower = self.heads()
        order, bound = _by_group(self.ranked[1][y // self.members], len(lower))
        z, (g, m) = _with_one(z, order), np.divmod(y[order], self.members)
        found = np.empty(len(y), z.dtype)
        for low in range(0, len(y), ROWS):
            part = slice(low, low + ROWS)
            logits = z[part] @ upper
            found[part] = _of(logits, g[part])
            found[part] -= np.log(_exp_sums(logits))
        for part, width, groups in self.runs(bound):
            own = z[part]
            logits = np.empty((len(own), width), z.dtype)
            for i, rows in groups:
                np.matmul(own[rows], lower[i, :, :width], out=logits[rows])
            found[part] += _of(logits, m[part])
            found[part] -= np.log(_exp_sums(logits))
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, used: np.ndarray | None = None) -> tuple[float, dict]:
        """Mean loss and its gradients over all positions, or over those that are used; places before a block's first used one are read, not predicted from."""
        w, (n, length) = self.weights, x.shape
        width = w["O"].shape[0]
        flat = lambda t: t.reshape(-1, t.shape[-1])
        used = np.ones(x.shape, bool) if used is None else used
        blocks = [(slice(i, i + WINDOWS), int(used[i : i + WINDOWS].any(0).argmax())) for i in range(0, n, WINDOWS)]
        z, states = np.ones((n, length, width + 1), w["E"].dtype), []  # the last column of ones meets the biases
        for b, skip in blocks:
            z[b, skip:, :width], state = self.hidden(x[b], skip)
            states.append(state)
        at = np.flatnonzero(used)
        g, m = np.divmod(y.ravel()[at], self.members)
        order, bound = _by_group(self.ranked[1][g], len(w["b"]))
        at, g, m, share = at[order], g[order], m[order], 1 / max(1, len(at))
        upper, lower = self.heads()
        fz = flat(z)[at]

        def wrong(logits: np.ndarray, right: np.ndarray) -> tuple[float, np.ndarray]:
            """Logits become their gradients but for a factor of each row; the summed loss and the factors."""
            loss = -float(_of(logits, right).sum())
            total = _exp_sums(logits)
            logits.reshape(-1)[np.arange(len(right)) * logits.shape[1] + right] -= total
            return (loss + float(np.log(total).sum())) * share, (share / total)[:, None]

        loss, d_upper, d_lower, dz = 0.0, np.zeros_like(upper), np.zeros_like(lower), np.empty((len(at), width), fz.dtype)
        for low in range(0, len(at), ROWS):
            part = slice(low, low + ROWS)
            p = fz[part] @ upper
            more, factor = wrong(p, g[part])
            loss += more
            d_upper += (fz[part] * factor).T @ p
            np.multiply(p @ w["V"].T, factor, out=dz[part])
        for part, wide, groups in self.runs(bound):
            own = fz[part]
            p, back = np.empty((len(own), wide), fz.dtype), np.empty((len(own), width), fz.dtype)
            for i, rows in groups:
                np.matmul(own[rows], lower[i, :, :wide], out=p[rows])
            more, factor = wrong(p, m[part])
            loss += more
            own = own * factor
            for i, rows in groups:
                np.matmul(own[rows].T, p[rows], out=d_lower[i, :, :wide])
                np.matmul(p[rows], w["W"][i, :, :wide].T, out=back[rows])
            back *= factor
            dz[part] += back
        out = {"V": d_upper[:-1], "b": d_upper[-1], "W": d_lower[:, :-1], "c": d_lower[:, -1]}
        by_place = np.zeros((n * length, width), dz.dtype)
        by_place[at] = dz
        by_place = by_place.reshape(n, length, width)
        out |= {k: np.zeros_like(w[k]) for k in ("O", "QKV", "P", "E")}
        for (b, skip), (h, q, k, v, s, part, a) in zip(blocks, states, strict=True):
            dh = by_place[b]
            dz = np.ascontiguousarray(dh[:, skip:])
            out["O"] += flat(a).T @ flat(dz)
            da = (flat(dz) @ w["O"].T).reshape(dz.shape)
            da *= part
            ds = da @ v.transpose(0, 2, 1)
            ds -= np.einsum("nld,nld->nl", da, a)[:, :, None]
            ds *= s
            dqkv = np.empty((*h.shape[:2], 3 * width), dz.dtype)
            dqkv[:, :skip, :width] = 0
            np.multiply(ds @ k, np.float32(width**-0.5), out=dqkv[:, skip:, :width])
            dqkv[:, :, width : 2 * width] = ds.transpose(0, 2, 1) @ q
            dqkv[:, :, 2 * width :] = s.transpose(0, 2, 1) @ da
            out["QKV"] += flat(h).T @ flat(dqkv)
            dh += (flat(dqkv) @ w["QKV"].T).reshape(h.shape)
        out["P"][:length] = by_place.sum(0)
        rows_of = x.ravel().astype(np.min_scalar_type(len(w["E"])))
        order = np.argsort(rows_of, kind="stable")
        row = rows_of[order]
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out["E"][row[head]] = np.add.reduceat(flat(by_place)[order], head)
        return loss, out

    def train(self, sequences: list[np.ndarray], steps: int = STEPS, batch: int = 64, rate: float = FIRST_RATE, seed: int = 4) -> None:
        """Adam on windows drawn from id sequences, each text after a start row."""
        r = np.random.default_rng(seed)
        start = self.weights["E"].shape[0] - 1
        target = np.concatenate([*sequences, np.zeros(0, np.int64)])
        if len(target) < LENGTH + 1:
            return
        wide = np.empty_like(target)
        wide[1:] = self.row_of[target[:-1]]
        wide[np.cumsum([0, *map(len, sequences[:-1])])] = start
        target = self.class_of[target]
        draws = (r.integers(0, len(wide) - LENGTH + 1, batch)[:, None] + np.arange(LENGTH) for _ in range(steps))
        self.descend(((wide[at], target[at], None) for at in draws), (rate * min(1, 3 * (1 - t / (steps + 1))) for t in range(1, steps + 1)))

    def refine(self, windows: np.ndarray, rate: float, batch: int = 64, whole: bool = False) -> None:
        """Adam over rows of ``drawn_windows``, each once, in their order. If they are all windows of whole texts, a later one predicts the ids that the one before doesn't, as in ``score``, so that each id counts once."""
        end = len(self.class_of) - 1
        class_of, row_of = np.append(self.class_of, [0, 0]), np.append(self.row_of, [self.weights["E"].shape[0] - 1, 0])  # with start and padding

        def first_ones_last(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first = (w[:, 0] == end + 1) | (not whole)
            w = w[np.argsort(first, kind="stable")]
            used = w[:, 1:] <= end
            used[: len(w) - first.sum(), : LENGTH - STEP] = False
            return w, used

        parts = (windows[i : i + batch].astype(np.int64) for i in range(0, len(windows), batch))
        self.descend(((row_of[w[:, :-1]], class_of[w[:, 1:]], used) for w, used in map(first_ones_last, parts)), itertools.repeat(rate))

    def descend(self, batches: Iterable[tuple], rates: Iterable[float]) -> None:
        flat = np.concatenate([w.ravel() for w in self.weights.values()])
        cuts = np.cumsum([w.size for w in self.weights.values()])[:-1]
        self.weights = {k: x.reshape(w.shape) for (k, w), x in zip(self.weights.items(), np.split(flat, cuts), strict=True)}
        m, v, step = (np.zeros_like(flat) for _ in range(3))
        for t, ((x, y, used), rate) in enumerate(zip(batches, rates), 1):  # noqa: B905
            _, g = self.gradients(x, y, used)
            g = np.concatenate([g[k].ravel() for k in self.weights])
            m *= 0.9
            m += np.multiply(g, 0.1, out=step)
            v *= 0.99
            g *= g
            v += np.multiply(g, 0.01, out=step)
            np.sqrt(np.divide(v, 1 - 0.99**t, out=step), out=step)
            step += 1e-8
            np.divide(m, step, out=step)
            step *= rate / (1 - 0.9**t)
            flat -= step

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each text, its end included; windows of all texts in batches, padded ones masked by causality."""
        n_texts, end = len(first) - 1, len(self.class_of) - 1
        counts = np.diff(first) + 1
        bound = np.concatenate([[0], np.cumsum(counts)])
        flat = np.full(bound[-1], end)
        owner = np.repeat(np.arange(n_texts), counts)
        inner = np.ones(bound[-1], bool)
        inner[bound[1:] - 1] = False
        flat[inner] = ids
        start = self.weights["E"].shape[0] - 1
        target = self.class_of[flat]
        source = np.empty_like(target)
        source[1:] = self.row_of[flat[:-1]]
        source[bound[:-1]] = start
        out = np.bincount(owner, self.log_within[flat], minlength=n_texts)
        head, n_windows = LENGTH - STEP, np.maximum(1, -(-(counts - LENGTH) // STEP) + 1)
        text = np.repeat(np.arange(n_texts), n_windows)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        begin = bound[text] + k * STEP
        for lead in (True, False):  # first windows score all their ids, later ones those after the overlap
            rows = np.flatnonzero((k == 0) == lead)
            skip = 0 if lead else head
            for lo in range(0, len(rows), BATCH):
                r = rows[lo : lo + BATCH]
                at = begin[r][:, None] + np.arange(LENGTH)
                inside = at < bound[text[r] + 1][:, None]
                x = source[np.where(inside, at, 0)]
                z = np.concatenate([self.hidden(x[i : i + WINDOWS], skip)[0] for i in range(0, len(x), WINDOWS)])
                inside = inside[:, skip:]
                at = at[:, skip:][inside]
                lp = self.log_probability(z[inside], target[at]).astype(np.float64) / np.log(10)
                out += np.bincount(owner[at], lp, minlength=n_texts)
        return out


def drawn_windows(ids: np.ndarray, size: int, row: int = 0, every: int = 1) -> np.ndarray:
    """A text's windows, or one of every ``every``: the id before it, or size + 1 as start, and LENGTH ids, the end being ``size`` and padding size + 2."""
    n = max(1, -(-(len(ids) + 1 - LENGTH) // STEP) + 1)
    wide = np.concatenate([[size + 1], ids, [size], np.full(LENGTH, size + 2)])
    pick = (row % n + every * np.arange(-(-n // every))) % n
    return wide[pick[:, None] * STEP + np.arange(LENGTH + 1)]


def classes(freq: np.ndarray, spaced: np.ndarray, groups: int = GROUPS, members: int = MEMBERS, inputs: int = INPUTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, log10 of the share of its class, input row) of each id, the end's being last, and the classes' frequencies (groups, members).

    By the ids' counts over all training texts, 0.1 added: ids in the order of frequency, those
    that begin words first, are cut into groups of about equal frequency and these into classes.
    """
    size = len(freq) - 1
    freq = freq + 0.1
    order = np.lexsort((-freq, ~spaced))

    def cut(of: np.ndarray, n: int) -> np.ndarray:
        """Parts 0 to n - 1 by running frequency; a frequent id may fill several, of which it takes the first."""
        return np.minimum((np.cumsum(of) - of) / of.sum() * n, n - 1).astype(np.int64)

    of = freq[order]
    _, group = np.unique(cut(of, groups), return_inverse=True)
    class_of = np.empty(size + 1, np.int64)
    bound = np.searchsorted(group, np.arange(group[-1] + 2))
    for g, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)):
        class_of[order[a:b]] = g * members + (np.arange(b - a) if b - a <= members else np.unique(cut(of[a:b], members), return_inverse=True)[1])
    whole = np.bincount(class_of, freq, (group[-1] + 1) * members)
    rank = np.empty(size + 1, np.int64)
    rank[np.argsort(-freq, kind="stable")] = np.arange(size + 1)
    row_of = np.where(rank < inputs, rank, inputs + class_of // members)
    return class_of, np.log10(freq / whole[class_of]), row_of, np.maximum(whole, 1e-9).reshape(-1, members) / whole.sum()


def fit(freq: np.ndarray, spaced: np.ndarray, sequences: list[np.ndarray], steps: int = STEPS, **sizes: int) -> Attention:
    """A model with the classes of these counts and first weights from a bounded list of texts."""
    model = Attention.fresh(*classes(freq, spaced, **sizes))
    model.train(sequences, steps)
    return model


def shares(chunks: DataFrame, n: int) -> tuple[DataFrame, int, int]:
    """Packed rows that tell each chunk the counts of its words, and the number of training tokens and of different ones.

    chunks: (chunk, hashes, counts), a row for each chunk: its distinct words' hashes, ascending,
    and how often each stands in its training texts. Only counts above 0 are told, by index.
    """
    slots = spread(chunks.sparkSession, n)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = np.frombuffer(hashes, _U)
                yield pack(slots, (mix64(key) % _U(n)).astype(np.int64), np.zeros(len(key), np.int64), key, np.array([chunk], np.int64).view(_U), places=np.arange(len(key)), values=unplanes(counts, np.uint32))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Unpacked(batches)
        if not len(got.keys):
            return
        known, which = np.unique(got.keys, return_inverse=True)
        total = np.bincount(which, got.values, len(known)).astype(np.int64)
        c = total[which]
        told = np.flatnonzero(c > 0)
        order = np.lexsort((got.places[told], got.ids[got.run[told]]))
        told = told[order]
        chunk = got.ids[got.run[told]]
        if len(told):
            head = np.append(True, chunk[1:] != chunk[:-1])
            yield pack(slots, (mix64(chunk) % _U(n)).astype(np.int64), np.cumsum(head) - 1, c[told].astype(_U), chunk[head], places=got.places[told])
        sums = pack([-1], np.zeros(2, np.int64), np.zeros(2, np.int64), np.array([total.sum(), (total > 0).sum()], _U), np.zeros(1, _U))
        yield sums

    told = written(dealt(chunks, send, n).transform(mapped, match, PACKED))
    tokens = distinct = 0
    for r in told.where("slot < 0").select("keys").toLocalIterator():  # two numbers of each reducer
        tokens, distinct = (int(x) + y for x, y in zip(np.frombuffer(r[0], _U), (tokens, distinct), strict=True))
    return told.where("slot >= 0"), tokens, distinct


def with_base(scored: DataFrame, told: DataFrame, n: int, tokens: int, distinct: int, kept: str) -> DataFrame:
    """The scored rows (slot, chunk, words, _id, held_out, n_tokens, score) with n_known and base_score, from the counts told to their chunks."""
    floor = math.log10(tokens + 0.1 * (distinct + 1))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[pa.RecordBatch] = []

        def counts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column("words").is_valid()
                texts.append(batch.filter(text).select(["chunk", "words", "_id", "held_out", "n_tokens", "score"]))
                yield batch.filter(pc.invert(text)).select(["slot", *PARTS])

        got = Unpacked(counts())
        order = np.argsort(got.ids[got.run], kind="stable")
        chunk = got.ids[got.run[order]]
        head = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else np.zeros(0, np.int64)
        parts = dict(zip(chunk[head].view(np.int64).tolist(), np.split(order, head[1:]), strict=True)) if len(chunk) else {}
        own, logs, known = None, np.full(1, -1.0), np.zeros(1, bool)
        for batch in texts:
            n_known, base = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, (name, raw) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("words"), strict=True)):
                if name != own:
                    own, at = name, parts.get(name, np.zeros(0, np.int64))
                    place = got.places[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)
                    c = np.zeros(int(place.max(initial=-1)) + 2)  # the last for words that stand in no training text
                    c[place] = got.keys[at]
                    logs, known = np.log10(c + 0.1), c > 0
                which = np.minimum(unplanes(raw.as_py(), np.uint32), len(logs) - 1)
                n_known[i], base[i] = known[which].sum(), logs[which].sum()
            base -= batch.column("n_tokens").to_numpy() * floor
            columns = [*(batch.column(c) for c in ("_id", "held_out", "n_tokens")), pa.array(n_known), pa.array(base), batch.column("score")]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    both = scored.unionByName(told, allowMissingColumns=True).repartition(n, "slot")
    return both.transform(mapped, merge, f"_id {kept}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def _kind(size: int) -> str:
    return "<u2" if size + 2 < 1 << 16 else "<u4"


def _split(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids of each text and its words by index; after each chunk's texts a row with the chunk's words."""
    size = _tokenizer(path)[0].n_vocab
    kind = _kind(size)
    for batch in batches:
        learn = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for c in subwords(path, batch.column(2)):
            texts = [c.ids[a:b] for a, b in zip(c.first[:-1], c.first[1:], strict=True)]
            here, name, end = slice(c.low, c.high), secrets.randbits(63), len(c.hashes)
            words = [planes(np.append(c.which[a:b], end).astype(np.uint32)) for a, b in zip(c.at[:-1], c.at[1:], strict=True)]
            n = np.diff(c.at)
            times = np.bincount(c.which[np.repeat(learn[here], n)], minlength=end + 1)
            times[end] = learn[here].sum()
            own = {"_row": batch.column(0), "held_out": batch.column(1), **{k: batch.column(k) for k in batch.schema.names[3:]}}
            own = {k: v.slice(c.low, c.high - c.low) for k, v in own.items()}
            own |= {"n_tokens": pa.array(n + 1), "ids": pa.array([x.astype(kind).tobytes() for x in texts], pa.binary())}
            own |= {"chunk": pa.array([name] * len(texts), pa.int64()), "words": pa.array(words, pa.binary())}
            own |= {k: pa.nulls(len(texts), pa.binary()) for k in ("hashes", "counts")}
            names = list(own)
            yield pa.RecordBatch.from_arrays(list(own.values()), names)
            whole = {"chunk": pa.array([name], pa.int64()), "hashes": pa.array([np.append(c.hashes, _END).tobytes()], pa.binary()), "counts": pa.array([planes(times.astype(np.uint32))], pa.binary())}
            yield pa.RecordBatch.from_arrays([whole.get(k, pa.nulls(1, own[k].type)) for k in names], names)


def _count(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size + 1, np.int64)
    for batch in batches:
        total[size] += batch.num_rows
        for raw in batch.column(0):
            total += 0 if not raw.as_py() else np.bincount(np.frombuffer(raw.as_py(), _kind(size)), minlength=size + 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def _all_windows(texts: list[bytes], size: int, seed: int) -> np.ndarray:
    """All windows of texts given as ids, in an order by chance that the seed fixes."""
    windows = np.concatenate([drawn_windows(np.frombuffer(x, _kind(size)).astype(np.int64), size) for x in texts]).astype(_kind(size))
    return windows[np.random.default_rng(seed).permutation(len(windows))]


def _refine(batches: Iterator[pa.RecordBatch], model: Attention, rate: float) -> Iterator[pa.RecordBatch]:
    """For each shard of a partition its number of windows, and the weights times it after training on them. A row has a text's windows or its ids."""
    size = len(model.class_of) - 1
    shards: dict[int, list[bytes]] = {}
    for batch in batches:
        for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shards.setdefault(shard, []).append(raw)
    for shard, raw in shards.items():
        whole = batch.schema.names[1] == "ids"
        windows = _all_windows(raw, size, shard) if whole else np.frombuffer(b"".join(raw), _kind(size)).reshape(-1, LENGTH + 1)
        each = min(max(64, len(windows) // 64), 256)  # larger batches where they leave steps enough
        own = Attention({k: w.copy() for k, w in model.weights.items()}, model.class_of, model.log_within, model.row_of)
        own.refine(windows, rate * (each / 64) ** 0.5, each, whole)
        flat = np.concatenate([w.ravel() for w in own.weights.values()]).astype(np.float64) * len(windows)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [len(windows)], "w": [flat.tobytes()]})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, least = 0, 0.0, None
    for batch in batches:
        for shard, count, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, total, least = n + count, total + np.frombuffer(raw), shard if least is None else least
    if n:
        yield pa.RecordBatch.from_pydict({"shard": pa.array([least], pa.int32()), "n": [n], "w": [total.tobytes()]})


def refined(model: Attention, learn: DataFrame, shard: int = SHARD, rounds: int = ROUNDS, rate: float = RATE) -> Attention:
    """The model after rounds over the windows of all of learn (_row, and windows or the ids of a text, which gives all of its windows), each in one round.

    Shards follow the rows' hashes, so that the weights don't follow the partitions.
    """
    of, item = learn.columns[1], np.dtype(_kind(len(model.class_of) - 1)).itemsize
    own = F.greatest(F.lit(1), F.ceil((F.length(of) / item + 1 - LENGTH) / STEP) + 1) if of == "ids" else F.length(of) / (item * (LENGTH + 1))
    whole = learn.agg(F.sum(own)).first()[0] or 0
    k = max(1, math.ceil(whole / shard))
    slots = F.array(*map(F.lit, spread(learn.sparkSession, k)))
    dealt_rows = learn.withColumn("_s", F.get(slots, F.pmod(F.xxhash64("_row"), F.lit(k)).cast("int"))).withColumn("_round", F.pmod(F.xxhash64("_row", F.lit(1)), F.lit(rounds)))
    schema = "shard int, n long, w binary"
    for i in range(rounds if whole else 0):
        mine = dealt_rows.where(F.col("_round") == i).select("_s", "_row", of).repartition(k, "_s").sortWithinPartitions("_s", "_row", of).select("_s", of)
        sums = mine.transform(mapped, partial(_refine, model=model, rate=rate * (1 - i / rounds)), schema)
        if k > 1:  # few sums come to the driver
            few = math.ceil(k**0.5)
            sums = sums.repartition(few, F.pmod(F.xxhash64("shard"), F.lit(few))).sortWithinPartitions("shard").transform(mapped, _add, schema)
        got = sorted((r.shard, r.n, bytes(r.w)) for r in sums.collect())
        if got:
            flat = sum(np.frombuffer(w) for _, _, w in got) / sum(n for _, n, _ in got)
            cuts = np.cumsum([w.size for w in model.weights.values()])[:-1]
            weights = {name: x.reshape(w.shape).astype(np.float32) for (name, w), x in zip(model.weights.items(), np.split(flat, cuts), strict=True)}
            model = Attention(weights, model.class_of, model.log_within, model.row_of)
    return model


def _run(batches: Iterator[pa.RecordBatch], model: Attention, slots: list[int], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    kind, n = _kind(len(model.class_of) - 1), np.array(slots, np.int32)
    for batch in batches:
        score, raw = np.zeros(batch.num_rows), batch.column("ids")
        bound = np.concatenate([[0], np.cumsum(pc.binary_length(raw).to_numpy() // np.dtype(kind).itemsize)])
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(bound, bound[low] + size, "right")) - 1)
            ids = np.frombuffer(b"".join(x.as_py() for x in raw[low:high]), kind).astype(np.int64)
            score[low:high] = model.score(ids, bound[low : high + 1] - bound[low])
            low = high
        slot = n[(mix64(batch.column("chunk").to_numpy().view(_U)) % _U(len(n))).astype(np.int64)]
        names = ["chunk", "words", "_id", "held_out", "n_tokens"]
        yield pa.RecordBatch.from_arrays([pa.array(slot), *(batch.column(c) for c in names), pa.array(score)], ["slot", *names, "score"])


def lm_scores(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", folds: int = 10, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; other columns are not read.

    tokenizer: the path of a file of a byte-level tokenizer's ranks that all executors have. Rows
    whose crc32(id) mod ``folds`` is 0 are held out of all that is learnt. A null text counts as
    empty: its one token is the end. Long texts are scored window by window; their ids and words
    are in memory at once. Rows of null or repeated ids, and equal rows, are scored each by
    itself, equal texts alike. Without rows to learn from, and for words that none of them has,
    counts are 0. An empty table gives an empty result.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id).cast("string"), value).alias("_row"), held_out(id, folds).alias("held_out"), value.alias("_text"), F.col(id).alias("_id"))
    kept, n = docs.schema[id].dataType.simpleString(), fanout(docs)
    with shuffles_freed(docs.sparkSession):  # else those of all rounds lie on disk together
        split = written(rows.transform(mapped, partial(_split, path=tokenizer), f"_row long, held_out boolean, _id {kept}, n_tokens long, ids binary, chunk long, words binary, hashes binary, counts binary"))
        learn, size = split.where("not held_out"), _tokenizer(tokenizer)[0].n_vocab
        freq = np.zeros(size + 1)
        for i, count in learn.select("ids").transform(mapped, partial(_count, size=size), "id long, n long").groupBy("id").agg(F.sum("n")).collect():
            freq[i] = count
        share = min(1.0, 1.5 * sample / max(freq[size], 1))  # by hash, so that tasks send the driver little more than the sample
        drawn = learn.withColumn("_h", F.pmod(F.xxhash64("_row"), F.lit(1 << 30))).where(F.col("_h") <= int(share * (1 << 30))).orderBy("_h", "ids").select("ids").limit(sample)
        first = [np.append(np.frombuffer(x, _kind(size)).astype(np.int64), size) for x in sorted(bytes(r[0]) for r in drawn.collect())]
        model = refined(fit(freq, np.append(_tokenizer(tokenizer)[1], True), first, steps), learn.select("_row", "ids"))
        told, tokens, distinct = shares(split.where("hashes is not null").select("chunk", "hashes", "counts"), n)
    slots = spread(docs.sparkSession, n)
    texts = split.where("hashes is null").select("chunk", "words", "_id", "held_out", "n_tokens", "ids")
    scored = texts.transform(mapped, partial(_run, model=model, slots=slots), f"slot int, chunk long, words binary, _id {kept}, held_out boolean, n_tokens long, score double")
    out = with_base(scored, told, n, tokens, distinct, kept)
    return out.select(F.col("_id").alias(id), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
