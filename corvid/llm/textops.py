"""Vectorised kernels over batches of UTF-8 text.

A batch is one byte buffer plus offsets, cut into slices of about a MB so that
the 8-byte working arrays stay small whatever the batch holds; a text that is
longer than a slice is a slice of its own and is never shortened. Words and
lines get 64-bit hashes from one prefix sum of keyed bytes times powers of an
odd base, so that a hash costs a subtraction and a multiplication however long
the word is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_KEYS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

_all = np.arange(256)
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)
#: Bytes of words that white space ends: all but 0x20 and 0x09-0x0D.
NOT_SPACE = ~((_all == 32) | ((_all >= 9) & (_all <= 13)))
#: Bytes of words of digits, lower-case letters and everything beyond ASCII.
ALNUM = (((_all >= 48) & (_all <= 57)) | ((_all >= 97) & (_all <= 122)) | (_all >= 128))
ALNUM_ANY_CASE = ALNUM | ((_all >= 65) & (_all <= 90))
NOT_NEWLINE = _all != 10

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        full = np.full(size, _BASE if kind == "up" else _BACK, np.uint64)
        full[0] = 1
        have = _powers[kind] = np.multiply.accumulate(full)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix1(x: int) -> np.uint64:
    return mix(np.array([x & (2**64 - 1)], np.uint64))[0]


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(buf: np.ndarray, offs: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of the table's bytes, no run passing a
    text's end, and the index of each text's first run (len(offs) entries)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = table[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offs[1:] > offs[:-1]
    a, b = offs[:-1][filled], offs[1:][filled] - 1
    first[a] = inside[a]
    last[b] = inside[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def line_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of \\n-split lines; an empty text is one empty line."""
    nl = np.flatnonzero(buf == 10)
    doc_of_nl = np.searchsorted(offs, nl, "right") - 1
    doc = np.concatenate([np.arange(len(offs) - 1), doc_of_nl])
    start = np.concatenate([offs[:-1], nl + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    closing = np.ones(len(doc), bool)
    closing[:-1] = doc[1:] != doc[:-1]
    end[closing] = offs[1:][doc[closing]]
    return start, end, doc


def prefix_sums(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """What range_hashes needs of a buffer, with A-Z folded if lower."""
    n = len(buf)
    keys = _KEYS[LOWER] if lower else _KEYS
    total = np.zeros(n + 1, np.uint64)
    np.multiply(keys[buf], _power("up", n + 1)[:n], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    return total


def range_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes."""
    h = (total[ends] - total[starts]) * _power("down", len(total))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * U(0xD1B54A32D192ED03))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return range_hashes(prefix_sums(buf, lower), starts, ends)


def hash_words(words: list[str], lower: bool = False) -> np.ndarray:
    """span_hashes of each of the given words."""
    raw = [w.encode() for w in words]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), offs[:-1], offs[1:], lower)


def windows(h: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the n-item windows that lie within one text."""
    total = len(h) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = h[:total].copy()
    for k in range(1, n):
        g *= U(0xFF51AFD7ED558CCD)
        g += h[k : k + total]
    g = mix(g)
    inside = np.ones(total, bool)
    for k in range(1, n):  # windows that pass a text's end
        cut = ptr[1:-1] - k
        inside[cut[(cut >= 0) & (cut < total)]] = False
    keep = np.flatnonzero(inside)
    return keep, g[keep]


def owners(ptr: np.ndarray) -> np.ndarray:
    """The text number of each item."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of a mask or of counts over each text's range."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
