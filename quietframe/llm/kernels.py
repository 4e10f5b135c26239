"""Vectorised numpy kernels over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = U64(0x5851F42D4C957F2D)
_INV = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_COEF = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)

#: Upper-case ASCII letters to lower case; everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for bytes of a word `[^\x20\x09-\x0D]+`.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: True for bytes of a (lower-cased) word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        out = []
        for b in (_BASE, _INV):
            x = np.full(m, b, U64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=U64))
        if m > 1 << 23:  # of one very long text only; not kept
            return tuple(out)
        _powers = tuple(out)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * _M2
    x = (x ^ (x >> U64(27))) * _M3
    return x ^ (x >> U64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type) and not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(col):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def regrouped(batches, most: int):
    """The rows of batches with a column text, in batches of about `most` bytes of text."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.get_total_buffer_size()
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def row_slices(offsets: np.ndarray, most: int = 1 << 21):
    """Row ranges of about `most` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Starts, ends (exclusive) and rows of the words of lower-cased bytes."""
    isw = table[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    begin = isw.copy()
    begin[1:] &= ~isw[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begin[at] = isw[at]
    end = isw.copy()
    end[:-1] &= ~isw[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = isw[last]
    ws, we = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return ws, we, np.searchsorted(offsets, ws, "right") - 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    s = np.empty(len(data) + 1, U64)
    s[0] = 0
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], dtype=U64, out=s[1:])
    return s


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], the same wherever the bytes stand."""
    h = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mix(h + (ends - starts).astype(U64) * _M1)


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words (rows are not looked at)."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = np.full(m, (n * int(_M1)) % (1 << 64), U64)
    for k in range(n):
        h += mix(word_hashes[k : k + m] ^ _COEF[k]) * _COEF[k + 13]
    return mix(h)


def trim() -> None:
    """At the end of a task: what the allocators hold goes back to the system, as idle
    Python workers stay beside those of the next stage."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
