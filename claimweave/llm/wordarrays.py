"""Words of many texts at once, as numpy arrays over the UTF-8 buffer of an Arrow column.

A word is a run of bytes other than the six ASCII white-space bytes, which is the regular
expression ``[^\\x20\\x09-\\x0D]+`` on the decoded text. Nothing here loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = (1 << 20) - 2  # so that tables of powers for a chunk end at 2**20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
#: The byte that each byte counts as where A-Z count as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo a modulus of at most 2**32, or 2**64 if it is 0; grown by doubling."""
    have = _powers.get((base, modulus))
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        with np.errstate(over="ignore"):
            while len(have) < n:
                step = U64(pow(base, len(have), modulus or 1 << 64))
                more = have * step
                have = np.concatenate([have, more % U64(modulus) if modulus else more])
        _powers[base, modulus] = have
    return have[:n]


@dataclass
class Words:
    """Words of some texts: byte spans in ``data``; those of text i are first[i]:first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with fold, A-Z count as a-z."""
        n = len(self.data)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, U64)
            np.cumsum((_FOLDED if fold else _BYTE)[self.data] * powers(_BASE_INVERSE, 0, n), out=sums[1:])
            return mix64((sums[self.ends] - sums[self.starts]) * powers(_BASE, 0, n + 1)[self.starts])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type not in (pa.string(), pa.large_string()):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if texts.type == pa.large_string() else np.int32
    off = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def spans(data: np.ndarray, off: np.ndarray, separator: np.ndarray = _SPACE) -> Words:
    inside = ~separator[data]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = off[:-1] < off[1:]
        heads, tails = off[:-1][full], off[1:][full] - 1
        begin[heads] = inside[heads]  # a text's first byte never continues the text before it
        end[tails] = inside[tails]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off))


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, bytes, offsets) of runs of whole texts of about ``size`` bytes, so that memory follows the chunk or the longest text and not the batch."""
    data, off = text_buffer(texts)
    low = 0
    while low < len(off) - 1:
        high = max(low + 1, int(np.searchsorted(off, off[low] + size, "right")) - 1)
        yield low, high, data[off[low] : off[high]], off[low : high + 1] - off[low]
        low = high


def windows(first: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of so many words starts and stays inside its text."""
    n = int(first[-1])
    stay = np.zeros(n + 1, np.int64)
    lengths = np.diff(first)
    fits = lengths >= width
    np.add.at(stay, first[:-1][fits], 1)
    np.add.at(stay, first[1:][fits] - width + 1, -1)
    return np.flatnonzero(np.cumsum(stay[:n]))


def rabin_karp(tokens: np.ndarray, starts: np.ndarray, width: int, modulus: int, base: int) -> np.ndarray:
    """The polynomial hash modulo a prime of ``width`` tokens from each start, by differences of prefix sums.

    Tokens times falling powers of the base are summed up once, so each window costs one
    difference and one product, however wide it is.
    """
    n = len(tokens)
    p = U64(modulus)
    inverse = pow(base, -1, modulus)
    sums = np.zeros(n + 1, U64)
    np.cumsum((tokens % p) * powers(inverse, modulus, n) % p, out=sums[1:])
    return ((sums[starts + width] - sums[starts]) % p) * powers(base, modulus, n + 1)[starts] % p
