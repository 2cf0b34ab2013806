"""Whole Arrow batches of texts as NumPy arrays: words, hashes and shingles without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: A chunk of documents has about this many bytes of text (one longer document makes a chunk by itself).
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 3
#: Words are hashed eight bytes a step; what lies beyond this many bytes goes through a byte-string hash.
LONG_WORD = 256
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(member) -> np.ndarray:
    return np.array([member(b) for b in range(256)], bool)


#: Bytes of words: all but the six white-space characters; letters, digits and everything beyond ASCII.
NON_SPACE = byte_class(lambda b: b != 32 and not 9 <= b <= 13)
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes. Each step mixes in eight bytes in a way that is not linear in them, so that
    words made of like parts in another order do not collide as they would under a polynomial modulo 2^64.
    """
    size = end - start
    h = mix(size.astype(U64) + U64(BASE))
    if not len(h):
        return h
    eight = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at, on = start, None
    for j in range(0, min(LONG_WORD, int(size.max())), 8):
        if j:
            on = np.flatnonzero(size > j)
            at = start[on] + j
        x = eight[at] & _LOW[np.minimum((size if on is None else size[on]) - j, 8)]
        now = mix((h if on is None else h[on]) * U64(BASE) ^ mix(x + U64(j + 1)))
        if on is None:
            h = now
        else:
            h[on] = now
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] ^= U64(xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), BASE))
    return h


class Texts:
    """Texts of some rows: ``data`` (bytes), ``at`` (where each text starts, and the end)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1

    @staticmethod
    def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
        """(first row, end row, texts) for consecutive rows; nulls are empty texts."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if not len(column):
            return
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(column):
            end = max(row + 1, min(int(np.searchsorted(at, at[row] + limit, "right")) - 1, row + 4000, len(column)))
            yield row, end, Texts(data[at[row] : at[end]], at[row : end + 1] - at[row])
            row = end

    def words(self, member: np.ndarray, lower: bool = True) -> Words:
        data = LOWER[self.data] if lower else self.data
        inside = member[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = self.at[:-1] < self.at[1:]
            a, z = self.at[:-1][full], self.at[1:][full] - 1
            first[a], last[z] = inside[a], inside[z]
        return Words(data, np.flatnonzero(first), np.flatnonzero(last) + 1, self.at)

    def count(self, member: np.ndarray) -> np.ndarray:
        """Bytes of each text that belong to a class."""
        total = np.concatenate([[0], np.cumsum(member[self.data])])
        return total[self.at[1:]] - total[self.at[:-1]]


class Words:
    """``start`` and ``end`` of all words; the words of text i are those from ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, text_at: np.ndarray):
        self.start, self.end, self.at = start, end, np.searchsorted(start, text_at)
        self.hash = hash_words(data, start, end)

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.n)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, owner, first word) of all runs of ``k`` words; a text of fewer words, but not none, has one run."""
        h, n = self.hash, self.n
        if not len(h):
            return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
        run = np.zeros(max(0, len(h) - k + 1), U64)
        for j in range(k):
            run = mix(run * U64(BASE) + h[j : j + len(run)])
        owner = self.owner()
        whole = np.flatnonzero(owner[: len(run)] == owner[k - 1 :]) if len(run) else np.zeros(0, np.int64)
        out, own, at = [run[whole]], [owner[whole]], [whole]
        for m in range(1, k):
            short = np.flatnonzero(n == m)
            x = np.full(len(short), m, U64)
            for j in range(m):
                x = mix(x * U64(BASE) + h[self.at[short] + j])
            out.append(x), own.append(short), at.append(self.at[short])
        return np.concatenate(out), np.concatenate(own), np.concatenate(at)


def distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of hashes of ``n`` <= 4096 owners: (all members, ordered within each owner; where each begins)."""
    if not len(hashes):
        return hashes, np.zeros(n + 1, np.int64)
    key = (owner.astype(U64) << U64(52)) | (hashes >> U64(12))
    order = np.argsort(key)
    h, o = hashes[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    return h[new], np.searchsorted(o[new], np.arange(n + 1))


def reduce_by(ufunc, values: np.ndarray, at: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each stretch; ``empty`` for those without values."""
    out = np.full(len(at) - 1, empty, values.dtype)
    full = at[:-1] < at[1:]
    if full.any():
        out[full] = ufunc.reduceat(values, at[:-1][full])
    return out


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))
