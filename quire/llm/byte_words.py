"""Words of UTF-8 texts, found and hashed by numpy over the bytes of a whole batch.

A word is a run of bytes of a class, and no word goes over the end of its text. Its two 64-bit hashes are polynomials over
its bytes, taken as differences of running sums (all modulo 2^64, whose odd numbers have inverses) and then mixed; 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
#: Bytes whose running sums are held at a time.
_CHUNK = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers under which close ones lie far apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Words:
    """The words of a batch: first byte and end, text (by its place in the batch), and two hashes."""

    def __init__(self, first, end, text, h1, h2):
        self.first, self.end, self.text, self.h1, self.h2 = first, end, text, h1, h2

    def __len__(self) -> int:
        return len(self.first)


class Scanner:
    """Finds words made of the bytes of ``word``, in which ``alike`` gives the byte that each one counts as."""

    def __init__(self, word: bytes, alike: bytes = bytes(range(256))):
        self.word = np.zeros(256, bool)
        self.word[np.frombuffer(word, np.uint8)] = True
        letter = np.frombuffer(alike, np.uint8).astype(np.uint64)
        self.tables = [mixed((letter + np.uint64(1)) * np.uint64(b)) for b in _BASES]
        self.low = [powers(b, _CHUNK) for b in _BASES]
        self.back = [powers(inverse(b), _CHUNK) for b in _BASES]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """``offsets`` are the first bytes of the texts within ``data``, and the end of the last."""
        firsts, ends = [], []
        sums = [([], [], []), ([], [], [])]  # at first bytes, what undoes their place, at ends
        carry, base, undo = [0, 0], [1, 1], [1, 1]
        before = False
        for a in range(int(offsets[0]), int(offsets[-1]), _CHUNK):
            part = data[a : min(a + _CHUNK, int(offsets[-1]))]
            n = len(part)
            inside = self.word[part]
            fresh = np.zeros(n, bool)
            i, j = np.searchsorted(offsets, [a, a + n])
            fresh[offsets[i:j] - a] = True
            prior = np.empty(n, bool)
            prior[0], prior[1:] = before, inside[:-1]
            begun = np.flatnonzero(inside & (fresh | ~prior))
            over = np.flatnonzero(prior & (fresh | ~inside))
            firsts.append(begun + a)
            ends.append(over + a)
            for k in range(2):
                run = np.cumsum(self.tables[k][part] * self.low[k][:n], dtype=np.uint64)
                at = np.empty(n, np.uint64)
                at[0], at[1:] = 0, run[:-1]
                scale, shift = np.uint64(base[k]), np.uint64(carry[k])
                sums[k][0].append(at[begun] * scale + shift)
                sums[k][1].append(self.back[k][begun] * np.uint64(undo[k]))
                sums[k][2].append(at[over] * scale + shift)
                carry[k] = (carry[k] + int(run[-1]) * base[k]) & _MASK
                base[k] = base[k] * pow(_BASES[k], n, 1 << 64) & _MASK
                undo[k] = undo[k] * pow(inverse(_BASES[k]), n, 1 << 64) & _MASK
            before = bool(inside[-1])
        if before:
            ends.append(np.array([offsets[-1]], np.int64))
            for k in range(2):
                sums[k][2].append(np.array([carry[k]], np.uint64))
        first = np.concatenate([np.zeros(0, np.int64), *firsts])
        end = np.concatenate([np.zeros(0, np.int64), *ends])
        none = np.zeros(0, np.uint64)
        h = [mixed((np.concatenate([none, *s[2]]) - np.concatenate([none, *s[0]])) * np.concatenate([none, *s[1]])) for s in sums]
        return Words(first, end, np.searchsorted(offsets, first, side="right") - 1, *h)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column without nulls, and the offsets of its texts in them."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(1)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at.astype(np.int64)


def in_slices(batches, column: str, limit: int) -> Iterator:
    """The rows of Arrow batches in tables whose texts have at most ``limit`` bytes together, or are one text; texts stay whole."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        _, at = buffers(b.column(b.schema.get_field_index(column)))
        a = 0
        while a < len(b):
            i = int(np.searchsorted(at, at[a] + max(0, limit - size), side="right")) - 1
            if i <= a and held:  # the next text doesn't fit any more
                yield _joined(held)
                held, size = [], 0
                continue
            i = min(max(i, a + 1), len(b))
            held.append(b.slice(a, i - a))
            size += int(at[i] - at[a])
            a = i
        del b
    if held:
        yield _joined(held)


def _joined(held: list):
    import pyarrow as pa

    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all lowest bytes first: small ones compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)
