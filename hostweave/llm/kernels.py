"""Vectorised text kernels for Arrow batches: word hashes, shingle sets and character windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII other than letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = np.ones(max(n, CHUNK_BYTES), dtype=np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * CHUNK_BYTES:
            _POWERS[name] = have
    return have[:n]


def utf8_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, bytes, offsets) with about CHUNK_BYTES of UTF-8 each; a null is an empty text."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (bytes that aren't in `space`, by default `[^\\x20\\x09-\\x0D]+`) after lower-casing A-Z, and the place in them at which each text begins (one more entry than texts). With prefix, hashes of at most that many first bytes of each."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    first = np.zeros(len(data) + 1, dtype=bool)  # a text's first byte begins a word even without white space before
    first[offsets[:-1]] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUES[LOWER[data]] * powers("up", BASE, len(data)), out=total[1:])
    words = (total[ends] - total[starts]) * powers("down", INVERSE, len(data))[starts]
    return mix(words + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of k-word shingles; fewer words are one shingle, none is an empty set."""
    n = max(0, len(words) - k + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    mixed = mix(mixed)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(mixed[a : b - k + 1])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * np.uint64(0xA0761D6478BD642F) + w
            yield mix(np.array([h]))
        else:
            yield np.zeros(0, np.uint64)


def text_shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, data, offsets in utf8_chunks(texts):
        yield from shingle_hashes(*word_hashes(data, offsets), k)


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit values as an Arrow list column."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
