"""Vectorised word hashing of Arrow string columns: no Python loop over words."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: list[np.ndarray] = []

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: True for bytes that belong to a word of class [^\x20\x09-\x0D]; bytes of multi-byte characters are word bytes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, _CHUNK + 4096)
        _POW[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, dtype=np.uint64)])) for x in (_P, _P_INV)]
    return _POW[0], _POW[1]


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the n + 1 offsets of its values; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=len(arr) + 1 + arr.offset)[arr.offset:]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts have about `limit` bytes each (a longer text is a part), to bound working memory."""
    size = np.cumsum(np.diff(utf8(batch.column("text"))[1]))
    at, base = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(at, to - at)
        at, base = to, int(size[to - 1])


_LIBC = ctypes.CDLL(ctypes.util.find_library("c") or None)


def give_back() -> None:
    """Hand memory that a finished task has freed back to the system; workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def return_arrays() -> None:
    """From now on, this worker's arrays of a megabyte or more go back to the system as soon as they are freed."""
    if hasattr(_LIBC, "mallopt"):
        _LIBC.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows with the arrays freed


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same mapInArrow function, which hands freed memory back when its partition is done."""
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return outer


def hash_words(arr: pa.Array, classes: np.ndarray = NOT_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every text in order, A-Z lower-cased if so asked; offsets[i]:offsets[i+1] are text i's.

    classes maps bytes to classes: 0 is between words, and a word is a longest run of one other class. Null has no
    words. Texts are cut into pieces of about 1 MB at word boundaries, so memory per step is bounded
    by the longest single word; hashes do not depend on the cuts.
    """
    raw, off = utf8(arr)
    hashes: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    at, total = 0, len(raw)
    edges = off[1:-1]
    while at < total:
        end = min(total, at + _CHUNK)
        while end < total:  # move the cut to a place between words
            gaps = np.flatnonzero(classes[raw[at:end]] == 0)
            inner = edges[(edges > at) & (edges <= end)] if len(edges) else edges
            cut = max(at + int(gaps[-1]) + 1 if len(gaps) else at, int(inner[-1]) if len(inner) else at)
            if cut > at:
                end = cut
                break
            end = min(total, end + _CHUNK)
        b = raw[at:end]
        kind = classes[b]
        b = _LOWER[b] if lower else b
        m = kind != 0
        lo, hi = np.searchsorted(off, [at, end])
        local = off[lo:hi + 1]
        local = local[(local > at) & (local < end)] - at
        first = m.copy()
        first[1:] &= kind[1:] != kind[:-1]
        first[local] = m[local]
        last = m.copy()
        last[:-1] &= kind[:-1] != kind[1:]
        last[local - 1] = m[local - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            pw, inv = _powers(len(b))
            acc = np.zeros(len(b) + 1, dtype=np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * pw[:len(b)], out=acc[1:])
            h = (acc[e] - acc[s]) * inv[s]
            hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off).astype(np.int64)


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges starts[i]:ends[i], which are in order and don't overlap."""
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        b = raw[lo:hi]
        pw, inv = _powers(len(b) + 1)
        acc = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * pw[:len(b)], out=acc[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent hash of pairs."""
    return mix(a * np.uint64(0xA0761D6478BD642F) + mix(b + np.uint64(0xE7037ED1A0B428DB)))


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of one word sequence; with fewer than k words, the whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        h = np.array([n], dtype=np.uint64)
        for i in range(n):
            h = combine(h, words[i:i + 1])
        return h
    h = words[:n - k + 1]
    for i in range(1, k):
        h = combine(h, words[i:n - k + 1 + i])
    return h
