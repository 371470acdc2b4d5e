"""Rows packed by bucket: numpy columns laid end to end in one binary value.

Millions of small rows so cross a shuffle as a few large ones, and both ends work on whole
columns. A layout is a tuple of (name, dtype, values a row).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

Layout = tuple[tuple[str, str, int], ...]
SCHEMA = "bucket int, data binary"
#: Rows that one bucket is meant to hold, and bytes that a task packs at once.
BUCKET_ROWS = 400_000
WINDOW_BYTES = 1 << 25


def n_buckets(rows: int, least: int) -> int:
    return max(least, rows // BUCKET_ROWS + 1)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 64-bit hashes, by their upper half."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def pack(layout: Layout, cols: dict[str, np.ndarray], at: np.ndarray) -> pa.RecordBatch:
    """One row (bucket, data) for each bucket in ``at``."""
    o = np.argsort(at, kind="stable")
    at = at[o]
    cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else [0]
    parts = [np.ascontiguousarray(cols[name].astype(kind, copy=False)[o]) for name, kind, _ in layout]
    data = [b"".join([x[i:j].tobytes() for x in parts]) for i, j in zip(cut, cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(at[cut[:-1]], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])


def unpack(layout: Layout, data: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """The columns of all packed rows of ``data``."""
    size = sum(np.dtype(kind).itemsize * width for _, kind, width in layout)
    cols: dict[str, list[np.ndarray]] = {name: [] for name, _, _ in layout}
    for value in data:
        raw, at = value.as_buffer(), 0
        k = len(raw) // size
        for name, kind, width in layout:
            x = np.frombuffer(raw, kind, k * width, at)
            cols[name].append(x.reshape(k, width) if width > 1 else x)
            at += x.nbytes
    empty = {name: np.zeros((0, width) if width > 1 else 0, kind) for name, kind, width in layout}
    return {name: np.concatenate(x) if x else empty[name] for name, x in cols.items()}


def pairs_within(first: np.ndarray, last: np.ndarray, most: int):
    """(i, j) with first[i] <= j < last[i], in chunks of at most ``most`` pairs."""
    ends = np.cumsum(np.maximum(last - first, 0))
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, most):
        k = np.arange(at, min(at + most, total))
        i = np.searchsorted(ends, k, "right")
        yield i, last[i] - (ends[i] - k)
