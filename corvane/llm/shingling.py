"""Vectorised word and shingle hashes over the UTF-8 buffers of Arrow string columns.

A batch of texts is one byte buffer and an offset per text. Everything here works on whole buffers with numpy: no
Python loop over words. Words are the maximal runs of bytes outside space and \\t..\\r; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; keeps the 8-byte work arrays inside the CPU caches.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII bytes other than letters and digits: what lies between bare words.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = (np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1))[_FOLD]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = [np.uint64(x) for x in np.random.default_rng(77).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of them."""
    size = max(1 << 12, 1 << int(n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[size] = tuple(tables)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(offs: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `size` bytes; a longer text is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word, and the number of words before each text (n + 1)."""
    b = data[offs[0] : offs[-1]]
    offs = offs - offs[0]
    inside = ~apart[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[:-1] = inside
    edge[1:-1] &= ~inside[:-1]
    cut = offs[1:-1]
    cut = cut[cut < len(b)]
    edge[cut] = inside[cut]
    starts = np.flatnonzero(edge)
    stop = np.zeros(len(b) + 1, bool)
    if len(b):
        stop[-1] = inside[-1]
        stop[1:-1] = inside[:-1] & ~inside[1:]
        past = cut[cut > 0]
        stop[past] = inside[past - 1]
    return starts, np.flatnonzero(stop), np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = _SPACE, stems: tuple[int, ...] = ()):
    """A 64-bit hash per word, and the number of words before each text (n + 1). apart: the bytes between words.

    stems: also return, for each given length, the hashes of the words cut to that many bytes.
    """
    starts, stops, before = word_bounds(data, offs, apart)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return (none, before, [none] * len(stems)) if stems else (none, before)
    b = data[offs[0] : offs[-1]]
    power, inverse = _tables(len(b))
    run = np.empty(len(b) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTE[b] * power[: len(b)], out=run[1:])
    words = mix((run[stops] - run[starts]) * inverse[starts])
    if stems:
        return words, before, [mix((run[np.minimum(stops, starts + k)] - run[starts]) * inverse[starts]) for k in stems]
    return words, before


def gram_hashes(words: np.ndarray, offsets: tuple[int, ...], salt: int = 0) -> np.ndarray:
    """Hash of the words at i + each offset, for each i that has them all (texts' bounds are the caller's)."""
    n = len(words) - max(offsets)
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.full(n, np.uint64(salt), np.uint64)
    for k, off in enumerate(offsets):
        s += words[off : off + n] * _GRAM[k]
    return mix(s)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    With fewer than k words the whole sequence is the one shingle; without words the set is empty.
    """
    for i, j in chunks(offs):
        words, before = word_hashes(data, offs[i : j + 1])
        grams = gram_hashes(words, tuple(range(k)))
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(grams[a : b - k + 1])
                fresh = np.empty(len(s), bool)
                fresh[0] = True
                np.not_equal(s[1:], s[:-1], out=fresh[1:])
                yield s[fresh]
            elif b > a:
                yield gram_hashes(words[a:b], tuple(range(b - a)), salt=b - a)
            else:
                yield np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit identity of a set of hashes; 0 stands for the empty set."""
    if not len(s):
        return 0
    folded = np.array([np.bitwise_xor.reduce(mix(s)), np.add.reduce(s), len(s)], np.uint64) * np.array([1, 3, 5], np.uint64)
    return int(mix(np.add.reduce(folded, keepdims=True)).view(np.int64)[0]) or 1
