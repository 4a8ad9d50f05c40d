"""Array kernels over the UTF-8 bytes of an Arrow string column.

Words are runs of bytes other than the ASCII white space 0x20 and 0x09-0x0D. Nothing here makes a Python
object for a word; a batch is worked on in slices of about ``SLICE_BYTES`` so that memory stays bounded (one
text longer than that is a slice by itself).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RADIX = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("up", _RADIX), ("down", pow(_RADIX, -1, 1 << 64))):
            steps = np.full(BLOCK + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in the bytes); null texts are empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        chunk = pc.fill_null(chunk.cast(pa.large_string()), "")
        n = len(chunk)
        if n == 0:
            continue
        _, off, data = chunk.buffers()
        offsets = np.frombuffer(off, np.int64, n + 1, chunk.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield base + lo, base + hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi
        base += n


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (one more at the end)."""
    inside = ~SPACE[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(buf)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by differences of a running polynomial. Spans ascend."""
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
        if int(ends[j - 1]) - at > BLOCK:
            out[i] = int.from_bytes(hashlib.blake2b(buf[at : ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        part = buf[at : ends[j - 1]].astype(np.uint64) + np.uint64(1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=run[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix64((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring hashes (fewer than ``size``: none)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix64(total)


def text_of(bounds: np.ndarray) -> np.ndarray:
    """For each item the number of the text it lies in, from the bounds of the texts."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between neighbouring bounds."""
    run = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]
