"""Words, word hashes and shingle sets of whole texts, in numpy over Arrow batches.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; A-Z are lower-cased where shingles
are concerned. ``bytes.lower`` and ``bytes.split`` have exactly these two rules.
"""

from __future__ import annotations

import ctypes
import gc
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE = 5
#: Odd multipliers from a fixed generator: one for each place in a shingle, then one per bucket.
_rng = np.random.Generator(np.random.PCG64(20240611))
PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BUCKET = _rng.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words whose hashes a worker keeps; beyond it the memo starts anew, results don't depend on it.
MEMO = 150_000


class WordHashes(dict):
    """64-bit hashes of words, computed once per word and worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()
#: Longer words, in bytes, are hashed one by one.
LONG = 64
#: Masks of the first bytes of a little-endian word.
LOW_BYTES = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after the other, and the number of words of each."""
    lists = [() if t is None else t.encode().lower().split() if lower else t.encode().split() for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return list_hashes(lists, int(counts.sum())), counts


def list_hashes(lists: list[list[bytes]], total: int) -> np.ndarray:
    """Hashes of the words of lists, one after the other."""
    return np.fromiter(map(_hashes.__getitem__, chain.from_iterable(lists)), np.uint64, total)


def set_hashes(lists: list[list[bytes]], total: int) -> np.ndarray:
    """As list_hashes, by other hashes, without a look at each word: eight bytes of all words at a time. For many words at once, none with a space."""
    data = b" ".join(chain.from_iterable(lists)) + b" " * 8
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[:total]
    at = np.concatenate([[0], ends + 1])[:total]
    n = ends - at
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = mix(n.astype(np.uint64) * PLACE[5])
    left = np.flatnonzero(n <= LONG)
    for k in range(0, LONG, 8):
        left = left[n[left] > k] if k else left
        if not len(left):
            break
        block = eight[at[left] + k] & LOW_BYTES[np.minimum(n[left] - k, 8)]
        out[left] = mix(mix(out[left] ^ block) * PLACE[6])
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[at[i] : ends[i]])
    return out


def shingle_hashes(flat: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes with repeats, text by text, and their number for each text.

    A text with fewer than ``size`` words but at least one has its whole sequence as one shingle.
    """
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.cumsum(n) - n
    total = int(n.sum())
    if not total:
        return np.empty(0, np.uint64), n
    where = np.arange(total) + np.repeat(first - at, n)
    width = np.repeat(np.minimum(counts, size), n)
    padded = np.concatenate([flat, np.zeros(size, np.uint64)])
    out = width.astype(np.uint64) * PLACE[15]
    for k in range(size):
        term = mix(padded[where + k]) * PLACE[k]
        out = mix(out) + (np.where(width > k, term, np.uint64(0)) if (width < size).any() else term)
    return mix(out), n


def distinct_sets(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles sorted and without repeats, and their number for each text."""
    if not len(hashes):
        return hashes, n
    hashes = hashes.copy()
    ends = np.cumsum(n)
    for a, b in zip(ends - n, ends):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[(ends - n)[n > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return hashes[new], total[ends] - total[ends - n]


def release() -> None:
    """Give memory that is free back to the system: workers are reused, and stand beside executors that need it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # not glibc
    _libc = None
_kept: dict[str, object] = {}


def worker(name: str, make):
    """What a Python worker keeps between batches, made once for each name; only the last name's is kept, so operators' memos never add up."""
    if name not in _kept:
        _kept.clear()
        _hashes.clear()
        gc.collect()
        release()
        _kept[name] = make()
    return _kept[name]


def slices(n: np.ndarray):
    ends = np.cumsum(n)
    return zip((ends - n).tolist(), ends.tolist())


def parts(batch: pa.RecordBatch, size: int = 1 << 20, column: str = "text"):
    """Slices of a batch with about size bytes of text, one row at least: what is held at once stays small."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(lengths) - lengths + 64 * np.arange(len(lengths))) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
    release()
