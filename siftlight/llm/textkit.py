"""Vectorised byte-level helpers that run inside tasks: packed texts, words, 64-bit names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
_K1, _K2, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A fixed random 64-bit value for every byte.
BYTE_NAMES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each name (a bijection)."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def mix2(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """The name of an ordered pair of names."""
    return mix(a * _K1 + b * _K2 + U(salt * 0x9E37 + 0x51ED2701))


_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in ((0, _BASE), (1, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Spans:
    """Names of arbitrary spans of a sequence of names, by sums of prefixes."""

    def __init__(self, names: np.ndarray):
        p, self.inverse = powers(len(names) + 1)
        self.sums = np.zeros(len(names) + 1, U)
        np.cumsum(names * p[:len(names)], out=self.sums[1:])

    def fixed(self, length: int) -> np.ndarray:
        """The name of every span of this length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, U)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + U(length))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U) * _K2)


def pad(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out with one space after each; ``bounds[i]`` is the start of text i (its end: bounds[i+1] - 1)."""
    n = len(offsets) - 1
    bounds = offsets + np.arange(n + 1, dtype=np.int64)
    out = np.full(int(bounds[-1]), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = data
    return out, bounds


def words(padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of padded texts."""
    ink = np.zeros(len(padded) + 1, np.int8)
    ink[1:] = ~IS_SPACE[padded]
    edge = np.diff(ink)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words up to this many bytes are named lane by lane, longer ones by a cryptographic hash.
LANES = 8


def lanes(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    raw = np.zeros(len(padded) + 8, np.uint8)
    raw[:len(padded)] = padded
    return np.ndarray((len(padded),), "<u8", raw, 0, (1,))


def word_names(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word: eight bytes at a time are mixed in, so a name is no sum over its letters."""
    size = ends - starts
    at = lanes(padded)
    out = mix(at[starts] & _LANE_MASKS[np.minimum(size, 8)] ^ size.astype(U) * _K1)
    for k in range(1, LANES):
        more = np.flatnonzero(size > 8 * k)
        if not len(more):
            return out
        out[more] = mix(out[more] * _K2 + (at[starts[more] + 8 * k] & _LANE_MASKS[np.minimum(size[more] - 8 * k, 8)]))
    for i in np.flatnonzero(size > 8 * LANES):
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return out


def same_words(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each word is letter by letter the word numbered ``other``."""
    size = ends - starts
    at = lanes(padded)
    same = size == size[other]
    head = _LANE_MASKS[np.minimum(size, 8)]
    same &= (at[starts] & head) == (at[starts[other]] & head)
    more = np.flatnonzero(same & (size > 8))
    same[more] = at[ends[more] - 8] == at[ends[other[more]] - 8]
    for i in np.flatnonzero(same & (size > 16)):
        j = other[i]
        same[i] = i == j or np.array_equal(padded[starts[i]:ends[i]], padded[starts[j]:ends[j]])
    return same


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.empty(0, np.uint8)
    return d, o - o[0]


@contextlib.contextmanager
def uncollected():
    """Without the search for cycles, which walks every word that is held: what is made inside has none."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker gives freed memory back: idle workers stay alive beside the next stage's."""

    def wrapped(parts: Iterator) -> Iterator:
        with uncollected():
            yield from run(parts)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not every C library has it
            pass

    return wrapped


def squeeze(a: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def unsqueeze(b: bytes, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each length, end to end."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
