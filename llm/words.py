"""Vectorised word and shingle hashing over Arrow text batches.

Words are maximal runs of bytes other than space and 0x09-0x0D, which equals
``[^\\x20\\x09-\\x0D]+`` on UTF-8 text. A word's identity is a 64-bit fingerprint; at 10^12
distinct words a given pair collides with probability 2^-64. Everything works on whole
Arrow batches with numpy, in pieces of bounded size, so no Python loop touches a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that one vectorised step takes.
PIECE = 1 << 19


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _PINV):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


_POWERS = _power_tables(PIECE + 1024)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash's base and of its inverse; for a longer text than a piece they are made anew and not kept."""
    have = _POWERS if n <= len(_POWERS[0]) else _power_tables(n)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. offsets[i]:offsets[i+1] is row i."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word of rows laid end to end; words never cross a row's end."""
    gap = _SPACE[raw]
    first = ~gap
    first[1:] &= gap[:-1]
    last = ~gap
    last[:-1] &= gap[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = ~gap[inner]
    last[inner - 1] = ~gap[inner - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit fingerprint of each byte span; ``lower`` folds A-Z."""
    p, inv = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[raw] * p[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row), in row order, of each run of k words; a row of fewer words gives its whole sequence as one."""
    counts = np.bincount(row, minlength=n_rows)
    ends = np.cumsum(counts)
    h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= k:
        m = len(words) - k + 1
        acc = words[:m].copy()
        for j in range(1, k):
            acc *= _P
            acc += words[j : m + j]
        ok = row[:m] == row[k - 1 :]
        h, at = mix(acc[ok]), row[:m][ok]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        start = (ends - counts)[short]
        acc = counts[short].astype(np.uint64)
        for j in range(k - 1):
            has = j < counts[short]
            acc = np.where(has, acc * _P + words[np.minimum(start + j, len(words) - 1)], acc)
        h, at = np.concatenate([h, mix(acc)]), np.concatenate([at, short])
        o = np.argsort(at, kind="stable")
        h, at = h[o], at[o]
    return h, at


def distinct(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending within it; ``row`` must be sorted."""
    ends = np.searchsorted(row, np.arange(n_rows + 1))
    h = h.copy()
    for i in range(n_rows):
        h[ends[i] : ends[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


def shingle_sets(col: pa.Array, k: int = 5, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, hashes, row offsets) for pieces of a text column: sorted distinct shingles of each row."""
    raw, off = text_bytes(col)
    for i, j in pieces(off):
        part, po = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, r = word_spans(part, po)
        h, r = distinct(*shingles(hash_spans(part, s, e, lower), r, j - i, k), j - i)
        yield i, j - i, h, np.searchsorted(r, np.arange(j - i + 1))
