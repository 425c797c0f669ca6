"""Numpy views of Arrow string columns, and word scans over their bytes.

All functions work on whole columns: the bytes of all texts lie in one buffer
and ``offsets`` says where each begins. Temporary arrays are bounded by
``PIECE`` bytes of text at a time, however long a single text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: An odd multiplier; its inverse modulo 2**64 lets hashes of substrings come from prefix sums.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, PIECE + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", _INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def doc_groups(offsets: np.ndarray, limit: int = 2 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together, or a single longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def cuts(raw: np.ndarray, breaks: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Splits the buffer into parts of about PIECE bytes that end where no word is cut: at a text's start or after a byte outside words."""
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n:
            k = int(np.searchsorted(breaks, hi, "right")) - 1
            if breaks[k] > lo and breaks[k] > hi - PIECE // 2:
                hi = int(breaks[k])
                break
            outside = np.flatnonzero(~inside[raw[max(lo, hi - 65536) : hi]])
            if len(outside):
                hi = max(lo, hi - 65536) + int(outside[-1]) + 1
                break
            hi = min(n, hi + PIECE)
        yield lo, hi
        lo = hi


def word_values(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
    """(start of every maximal run of bytes marked in ``inside``, the runs' bytes as a binary column); runs end at the ends of texts, ``fold`` maps bytes."""
    on = inside[raw]
    first = on.copy()
    first[1:] &= ~on[:-1]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    first[at] = on[at]
    start = np.flatnonzero(first)
    kept = raw[on]
    body = kept if fold is None else fold[kept]
    # The runs lie side by side in ``body``, so each ends where the next begins.
    ends = np.append(np.cumsum(on, dtype=np.int64)[start] - 1, len(body)) if len(start) else np.zeros(1, np.int64)
    return start, pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(body)])


def different(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes and offsets of the different words of a binary column, the word at each place)."""
    coded = words.dictionary_encode()
    _, at, data = coded.dictionary.buffers()
    offsets = np.frombuffer(at, np.int64, len(coded.dictionary) + 1) if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[: offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8), offsets, coded.indices.to_numpy(zero_copy_only=False)


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray | None = None, stem: int = 0) -> tuple[np.ndarray, ...]:
    """(start, end, hash) of every maximal run of bytes marked in ``inside``; runs end at the ends of texts.

    ``fold`` maps bytes before hashing (lower-casing, for example). With ``stem``
    a fourth array has the hash of each word's first ``stem`` bytes, 0 for shorter words.
    """
    starts, ends, hashes, stems = [], [], [], []
    for lo, hi in cuts(raw, offsets, inside):
        part = raw[lo:hi]
        on = inside[part]
        first = on.copy()
        first[1:] &= ~on[:-1]
        at = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        first[at] = on[at]
        s = np.flatnonzero(first)
        if not len(s):
            continue
        off = np.flatnonzero(~on)
        nxt = np.append(off, len(part))
        e = nxt[np.searchsorted(off, s)]
        later = np.append(at, len(part))
        e = np.minimum(e, later[np.searchsorted(later, s, "right").clip(max=len(later) - 1)])
        up, down = powers(len(part) + 1)
        body = part if fold is None else fold[part]
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s]))
            if stem:
                stems.append(np.where(e - s >= stem, mix((total[np.minimum(s + stem, e)] - total[s]) * down[s] + np.uint64(1)), np.uint64(0)))
        starts.append(s + lo)
        ends.append(e + lo)
    kinds = (np.int64, np.int64, np.uint64, np.uint64)[: 4 if stem else 3]
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip((starts, ends, hashes, stems), kinds, strict=False))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def ascii_lower() -> np.ndarray:
    """The byte map that lower-cases A-Z and nothing else."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out
