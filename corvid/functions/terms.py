"""text.TERMS over Arrow batches: all terms of many texts at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_KIND = np.zeros(256, np.uint8)
_KIND[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"'-")] = 2


def tokens(texts: Sequence[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The terms of the texts in lower case, one after another, as
    re.findall(TERMS, text.lower()) gives them, and how many each text has."""
    low = [(t or "").lower().encode() for t in texts]
    buf = np.frombuffer(b"\n".join([b"", *low, b""]), np.uint8)
    kind = _KIND[buf]
    word = kind == 1
    inner = np.flatnonzero(kind == 2)
    inner = inner[word[inner - 1] & word[inner + 1]]  # a line's end is before and after each text
    word[inner] = True
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buf[word])])
    ends = np.cumsum([len(x) + 1 for x in low]) if low else np.zeros(0, np.int64)
    return found, np.diff(np.searchsorted(start, ends), prepend=0)
