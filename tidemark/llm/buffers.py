"""Vectorised work on runs of UTF-8 text: whole columns as one byte buffer plus offsets.

Nothing here knows about Spark.  Every function takes numpy arrays over the bytes of
many documents at once, so that the Python interpreter runs once for a block of text
and not once for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from tidemark.llm.xxh import xxh64

#: Bytes of text worked on at once; bounds the scratch arrays, which take some 100 bytes for each.
BLOCK_BYTES = 500_000

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(8)], np.uint64)
#: Seed of the hashes of spans; spans of more bytes are hashed one by one.
_SEED, _LONG = 7, 64


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column and n + 1 offsets; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(raw: np.ndarray, offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of whole texts of some ``most`` bytes; a longer text is a run of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        last = min(last, n)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as numbers; zeros follow the end."""
    padded = np.append(raw, np.zeros(16, np.uint8))
    return np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))


def span_keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span of bytes: up to seven bytes the span itself, beyond that a hash with the top bit set.

    Equal spans have equal keys wherever they stand.  Different spans of up to seven bytes
    have different keys; of n longer ones two collide with a chance of n * n / 2**64, which
    ``distinct_spans`` sees and mends and whoever compares keys of different blocks must bear.
    """
    length = end - start
    out = _eights(raw)[start] & _LOW[np.minimum(length, 7)] | np.minimum(length, 7).astype(np.uint64) << np.uint64(56)
    some = np.flatnonzero(length > 7)
    if len(some):
        h = np.zeros(len(some), np.uint64)
        short = length[some] <= _LONG
        h[short] = xxh64(raw, start[some[short]], length[some[short]], _SEED)
        for i in np.flatnonzero(~short):
            h[i] = int.from_bytes(hashlib.blake2b(raw[start[some[i]] : end[some[i]]], digest_size=8).digest(), "little")
        out[some] = h | np.uint64(1 << 63)
    return out


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each span of a, of at least eight bytes, has the bytes of that of b."""
    same = np.ones(len(length), bool)
    x, y = _eights(a), _eights(b)
    on, k = np.flatnonzero(length <= 8 * _LONG), 0
    while len(on):
        at = np.minimum(8 * k, length[on] - 8)
        same[on] &= x[a_start[on] + at] == y[b_start[on] + at]
        k += 1
        on = on[length[on] > 8 * k]
    for i in np.flatnonzero(length > 8 * _LONG):
        same[i] = np.array_equal(a[a_start[i] : a_start[i] + length[i]], b[b_start[i] : b_start[i] + length[i]])
    return same


def distinct_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the different spans each one's key and first place; and which of them every span is.  Bytes decide, not keys."""
    length = end - start
    key, one, which = np.unique(span_keys(raw, start, end), return_index=True, return_inverse=True)
    check = np.flatnonzero((length > 7) & (one[which] != np.arange(len(which))))
    first = one[which[check]]
    fits = length[check] == length[first]
    fits[fits] = same_spans(raw, start[check[fits]], raw, start[first[fits]], length[check[fits]])
    if not fits.all():
        others: dict[tuple[int, bytes], int] = {}
        more = []
        for i in check[~fits].tolist():
            name = int(which[i]), raw[start[i] : end[i]].tobytes()
            if name not in others:
                others[name] = len(one) + len(more)
                more.append(i)
            which[i] = others[name]
        key, one = np.append(key, key[[k for k, _ in others]]), np.append(one, more)
    return key, one, which


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * _MIX
        return h ^ (h >> np.uint64(29))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and n + 1 word offsets by text."""
    blank = np.zeros(len(raw) + 2, bool)
    blank[0] = blank[-1] = True
    blank[1:-1] = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
    inside = ~blank
    opens, closes = inside[1:-1] & blank[:-2], inside[1:-1] & blank[2:]
    inner = offsets[1:-1]  # a text's end ends a word even where the next begins with one
    inner = inner[(inner > 0) & (inner < len(raw))]
    if len(inner):
        opens[inner] |= inside[1:-1][inner]
        closes[inner - 1] |= inside[1:-1][inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes stay."""
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[start : start + length], joined, and their n + 1 offsets."""
    at = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    index = np.repeat(start - at[:-1], length)
    index += np.arange(at[-1])
    return flat[index], at


def run_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i] : offsets[i + 1]] for each i, zero for an empty run."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def packed(values: np.ndarray) -> bytes:
    """An array's bytes, those of equal rank together, compressed: sorted keys and small counts take a part of their room."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(planes.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()
