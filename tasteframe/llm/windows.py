"""Hashes of words and of windows of consecutive words, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from tasteframe.llm.common import mixed

#: Odd multipliers of two independent rolling hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


#: ASCII white space, as bytes.split() cuts; the first 0 to 8 bytes of eight.
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def joined_hashes(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the units of all texts, one text after the other, and where those of each text begin; then the end."""
    x = np.concatenate([np.zeros(0, dtype=np.uint64), *map(word_hashes, lists)])
    return x, np.cumsum([0, *map(len, lists)])


def text_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """joined_hashes of the words of texts (binary, without nulls), for all of them at once: no word becomes an object.
    A word's bytes are mixed eight at a time, from its length on; what it gives depends on the word alone."""
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    low, high = int(edges[0]), int(edges[-1])
    if low == high:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    edges -= low
    raw = np.zeros(high - low + 8, dtype=np.uint8)
    raw[:-8] = np.frombuffer(data, dtype=np.uint8)[low:high]
    solid = ~SPACES[raw[:-8]]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = edges[(edges > 0) & (edges < len(solid))]  # a text's end ends its word, though no space stands there
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    starts = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - starts
    eights = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
    x = mixed((eights[starts] & FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * BASES[0])
    own = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at = 8
    while len(own):
        x[own] = mixed(x[own] * BASES[1] + (eights[starts[own] + at] & FIRST[np.minimum(size[own] - at, 8)]))
        at += 8
        own = own[size[own] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        x[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + size[i]])
    return x, np.searchsorted(starts, edges)


def whole(bounds: np.ndarray, n: int) -> np.ndarray:
    """For every window of n values of joined texts, whether it lies in one of them."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    count = max(0, len(end) - n + 1)
    return np.arange(count) + n <= end[:count]


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values, from the least of runs that are powers of two."""
    if len(x) < n:
        return x[:0]
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def least_parts(x: np.ndarray, bounds: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """minimizers() for joined texts: the least hash of every window of n values, also across texts; whether the window
    lies in one text; and whether it is the first such window there whose minimizer stands where it does."""
    parts = mixed(rolling(x, k))
    h, inside = least(parts, n - k + 1), whole(bounds, n)
    new = inside.copy()  # the place stays the same if the value does, and it was not at the start that was left
    new[1:] &= ~inside[:-1] | (h[1:] != h[:-1]) | (parts[: max(0, len(h) - 1)] == h[:-1])
    return h, inside, new


def rolling(x: np.ndarray, n: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Rabin-Karp hashes of every n consecutive values, modulo 2**64: the sum of x[i + j] * base**(n - 1 - j). Built
    from windows of powers of two, as hash(ab) = hash(a) * base**len(b) + hash(b)."""
    if len(x) < n:
        return np.zeros(0, dtype=np.uint64)
    out, length, power, size = None, 0, x, 1
    while True:
        if n & size:
            if out is None:
                out, length = power, size
            else:  # power covers `size` values and stands before what is there
                keep = len(x) - (length + size) + 1
                out = power[:keep] * _power(base, length) + out[size : size + keep]
                length += size
        if size * 2 > n:
            return out
        power = power[: len(power) - size] * _power(base, size) + power[size:]
        size *= 2


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def minimizers(x: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of n values: the hash of that k-window in it whose hash is least, and where it starts (the
    first of equals). Both depend on the window's own values alone, and neighbouring windows mostly agree."""
    parts = mixed(rolling(x, k))
    if len(x) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.lib.stride_tricks.sliding_window_view(parts, n - k + 1).argmin(axis=1) + np.arange(len(x) - n + 1)
    return parts[at], at


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs."""
    return x.view(np.int64)
