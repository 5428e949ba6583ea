"""Word splitting, hashing and batching shared by the corpus operators.

Everything here works on UTF-8 bytes inside Spark tasks.  ASCII-only lower
casing and byte classes give exactly the word definitions of the operators,
because every byte of a multi-byte character is 0x80 or above.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes handled at once inside a task; bounds numpy's temporaries.
SLICE_BYTES = 2 << 20

_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_U = np.uint64


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(_ALNUM).split()


class WordHashes(dict):
    """word -> 64-bit hash, filled as words are met; cleared when it is large."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hash_words(docs: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all documents in order, and each document's bounds (one more than documents)."""
    bounds = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum([len(d) for d in docs], out=bounds[1:])
    out = np.empty(int(bounds[-1]), dtype=np.uint64)
    get = cache.__getitem__
    for d, a, b in zip(docs, bounds[:-1].tolist(), bounds[1:].tolist()):
        if b > a:
            out[a:b] = np.fromiter(map(get, d), dtype=np.uint64, count=b - a)
    return out, bounds


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (xor-shift-multiply)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (length n - k + 1, or empty)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = words[:n].copy()
    for i in range(1, k):
        acc *= _U(0x9E3779B97F4A7C15)
        acc += words[i : i + n]
        acc ^= acc >> _U(29)
    return mix(acc)


def window_docs(bounds: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of k entries over n concatenated entries: document of each window, and whether it stays inside."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = doc[: max(0, n - k + 1)]
    return start, np.arange(len(start)) + k <= bounds[1:][start]


def kept_in_worker(name: str, make: Callable):
    """An object that stays in the Python worker for later tasks (a cache: results never depend on it).

    The package's own globals would not do: its code may reach a worker anew with every task.
    """
    state = sys.modules.setdefault("packetrisk_worker_state", types.ModuleType("packetrisk_worker_state")).__dict__
    if name not in state:
        state[name] = make()
    return state[name]


def to_bytes(column) -> list[bytes]:
    """A string or binary Arrow column as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts hold about ``limit`` bytes; a longer text is a part of its own."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()], dtype=np.int64)
    part = np.cumsum(sizes) // limit if len(sizes) else sizes
    cut = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cut.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Flat values and the number of them in each row as an Arrow list column."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
