"""Compact binary columns of sorted keys and counts, so that exchanges carry a few bytes per entry."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Unsigned integers, transposed into byte planes and compressed; delta: sorted values as differences."""
    v = np.ascontiguousarray(values)
    if delta and len(v):
        v = np.concatenate([v[:1], np.diff(v)])
    planes = v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype=np.uint64, delta: bool = False) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size = np.dtype(dtype).itemsize
    v = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(dtype).reshape(-1)
    return np.cumsum(v, dtype=dtype) if delta else v
