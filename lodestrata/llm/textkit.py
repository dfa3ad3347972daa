"""Vectorised text primitives on UTF-8 bytes for Arrow batches.

All word classes used here split at ASCII bytes only, so bytes of multi-byte characters are word bytes
and splitting bytes equals splitting code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are worked on in slices of about this many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1_000_000

_CODES = np.arange(256)
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~((_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D)))
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (lower-cased text: digits, a-z and all beyond ASCII).
LOWER_ALNUM = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)
#: Lower-cases A-Z and nothing else.
LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)

#: What operators keep in a worker between tasks: how to drop it, by their module.
_kept: dict[str, Callable[[], None]] = {}


def keep(module: str, drop: Callable[[], None]) -> None:
    """Until a worker runs another module's function it keeps what ``drop`` drops."""
    _kept[module] = drop


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, without what other operators keep; then what it has freed goes back to the system: a worker lives on between tasks and stages."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for module in _kept.keys() - {run.__module__}:
            _kept.pop(module)()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # only glibc has it
            pass

    return whole


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each byte span ``data[start:end]``; spans ascend and don't overlap.

    Spans are hashed in groups of about ``SLICE_BYTES``, so that a very long text needs little more memory for it.
    """
    out, low, digest = np.zeros(len(starts), np.uint64), 0, xxhash.xxh64_intdigest
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + SLICE_BYTES)))
        first = starts[low]
        part = data[first : ends[high - 1]].tobytes()
        places = zip((starts[low:high] - first).tolist(), (ends[low:high] - first).tolist())
        out[low:high] = np.fromiter((digest(part[a:b]) for a, b in places), np.uint64, high - low)
        low = high
    return out


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = is_word[data]
    edges = np.flatnonzero(np.diff(flags))
    return edges[0::2], edges[1::2]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array, each of about ``limit`` bytes; together they cover every row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    low = used = 0
    for row, n in enumerate(sizes):
        if row > low and used + n > limit:
            yield low, row
            low, used = row, 0
        used += int(n)
    if len(sizes) > low:
        yield low, len(sizes)


def joined(texts: pa.Array, separator: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, a separator before each; with the starts and ends of the texts in it. Null is empty."""
    parts = [x.encode("utf-8") if x else b"" for x in texts.to_pylist()]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + len(separator))
    data = np.frombuffer(separator + separator.join(parts) if parts else b"", np.uint8)
    return data, ends - lengths, ends


def sums_between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values[start:end]`` for each range; ranges ascend and don't overlap."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    out = np.zeros(len(starts), kind)
    full = np.flatnonzero(ends > starts)
    if len(full):
        edges = np.stack((starts[full], ends[full]), 1).ravel()
        out[full] = np.add.reduceat(values, edges[:-1] if edges[-1] == len(values) else edges, dtype=kind)[::2]
    return out


def strings(array: pa.ChunkedArray | pa.Array) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
