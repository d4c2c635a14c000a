"""Vectorized 64-bit hashes of words and lines over the buffers of an Arrow batch.

A symbol s at place i of a word adds r(s, i) to its hash, where r mixes both into 64 random bits; one of a line adds a
random factor of the place times s. Unlike a polynomial in a fixed base, such sums have no structured collisions; and sums over
any run of places are differences of two running sums. Where a hash stands for a text's identity it is a cryptographic digest instead (digest()).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Text bytes that are hashed at once; the work arrays are some 40 times that.
SLICE_BYTES = 1 << 20
_SYMBOL, _PLACE, _CHAIN = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

_TABLE_PLACES = 64
_TABLE: np.ndarray | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def placed(symbols: np.ndarray, places: np.ndarray, seed: int = 0) -> np.ndarray:
    """r(symbol, place) of each symbol; another seed gives another r."""
    h = symbols.astype(np.uint64)
    h *= _SYMBOL
    h += places.astype(np.uint64) * _PLACE + np.uint64(seed * 0x2545F4914F6CDD1D % 2**64)
    return mix(h)


_FACTORS: dict[int, np.ndarray] = {}


def by_place(symbols: np.ndarray, places: np.ndarray, seed: int = 0) -> np.ndarray:
    """A random factor of each place times the symbol there: cheaper than placed(), and as good where sums are mixed afterwards."""
    table = _FACTORS.get(seed)
    most = int(places.max()) + 1 if len(places) else 0
    if table is None or len(table) < most:
        table = np.random.Generator(np.random.PCG64(20240229 + seed)).integers(0, 2**64, size=max(most, 1 << 16), dtype=np.uint64) | np.uint64(1)
        if len(table) <= 8 * SLICE_BYTES:
            _FACTORS[seed] = table
    return table[places] * (symbols.astype(np.uint64) + np.uint64(1))


def placed_bytes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """placed() of bytes, from a table for the first places."""
    global _TABLE
    if _TABLE is None:
        _TABLE = placed(np.tile(np.arange(256), _TABLE_PLACES), np.repeat(np.arange(_TABLE_PLACES), 256))
    out = _TABLE[(np.minimum(places, _TABLE_PLACES - 1) << 8) + data]
    late = np.flatnonzero(places >= _TABLE_PLACES)
    if len(late):
        out[late] = placed(data[late], places[late])
    return out


def running(values: np.ndarray) -> np.ndarray:
    """Running sums: entry i covers the first i values."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums


def digest(data: bytes | np.ndarray) -> bytes:
    """16 bytes that tell texts apart."""
    return hashlib.blake2b(data, digest_size=16).digest()


def chained(hashes: np.ndarray, count: int) -> list[np.ndarray]:
    """For 1 to count words: a hash of so many words from each word on (words past the end are left out)."""
    out = [mix(hashes)]
    for k in range(1, count):
        last = out[-1].copy()
        if k < len(hashes):
            last[:-k] = mix(last[:-k] * _CHAIN + hashes[k:])
        out.append(last)
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data, offsets


def lower_ascii() -> np.ndarray:
    """A byte table that maps A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_bytes() -> np.ndarray:
    """True for space and bytes 9 to 13."""
    table = np.zeros(256, dtype=bool)
    table[[32, *range(9, 14)]] = True
    return table


def punctuation_bytes() -> np.ndarray:
    """True for every ASCII byte but letters and digits."""
    table = np.zeros(256, dtype=bool)
    table[:128] = True
    for first, last in ((48, 57), (65, 90), (97, 122)):
        table[first : last + 1] = False
    return table


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice of texts.

    data holds the bytes of texts that lie between offsets (from 0). A word is a run of bytes for
    which breaks is False, inside one text. Returns each word's hash, start and end, and each text's
    first word (with one more entry at the end).
    """
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1]))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))) + 1 if len(data) else np.zeros(0, np.int64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    sums = running(placed_bytes(data[inside], place))
    return mix(sums[first + size] - sums[first] + size.astype(np.uint64)), starts, ends, np.searchsorted(starts, offsets)
