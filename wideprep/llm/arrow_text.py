"""Vectorised text handling on Arrow string columns, for use inside ``mapInArrow``.

A string column is one buffer of UTF-8 bytes plus row offsets.  Words are
found, lower-cased and hashed on that buffer with numpy, never row by row.
Work memory is bounded: rows arrive in slices of a few MB and the wide
temporaries cover at most ``BLOCK`` bytes at a time, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64 (grown on demand, at most a block plus one word)."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, BLOCK + 256), base, dtype=np.uint64)
        steps[0] = 1
        known = _POWERS[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offs = offs.astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]]
    return raw, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, n_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``n_bytes`` per piece (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offs = string_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + n_bytes, side="right")) - 1
            to = min(batch.num_rows, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def byte_classes(word_bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(word_bytes)] = True
    return table


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: Words of letters and digits: everything but ASCII control, blank and punctuation.
WORD_BYTES = byte_classes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
LOWER = lower_table()


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the True runs inside each row, and for each row the number of
    runs before it (n + 1 values)."""
    if len(mask) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    edges = offsets[(offsets > 0) & (offsets < len(mask))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _word_groups(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive words that span about ``BLOCK`` bytes each."""
    at, n = 0, len(starts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        yield at, to
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """64-bit hash of every word, and of its first ``p`` bytes for each p in ``prefixes``
    (0 where the word has no more than p bytes)."""
    whole = np.empty(len(starts), np.uint64)
    parts = [np.zeros(len(starts), np.uint64) for _ in prefixes]
    for i, j in _word_groups(starts, ends):
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * powers(BASE, hi - lo), out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        shift, base = powers(BASE_INV, hi - lo + 1)[s], sums[s]
        whole[i:j] = mix((sums[e] - base) * shift)
        for p, out in zip(prefixes, parts):
            long = e - s > p
            out[i:j][long] = mix((sums[s[long] + p] - base[long]) * shift[long] + np.uint64(p))
    return whole, parts


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` consecutive word hashes (``len(words) - size + 1`` values)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        part = words[lo:hi + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(BASE, len(part)), out=sums[1:])
        out[lo:hi] = (sums[size:] - sums[:-size]) * powers(BASE_INV, hi - lo)
    return mix(out)
