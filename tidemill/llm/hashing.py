"""Words of Arrow text columns as 64-bit keys, in numpy, without a Python object for a word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import LOWER

_LOWER = np.frombuffer(LOWER, np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, 2 * PIECE), _powers(_INVERSE, 2 * PIECE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, A-Z in lower case, and the places where its texts start and end. Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return _LOWER[body], at - (at[0] if len(at) else 0)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, endings, n): a 64-bit key and a 32-bit hash of the last three bytes of each word [^\\x20\\x09-\\x0D]+, and how many words each text has.

    Keys are polynomials over the bytes modulo 2^64, mixed; the bytes are worked through in pieces, so that long texts need no more memory a byte.
    """
    body, at = text_bytes(column)
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
    space = _SPACE[body]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    some = at[:-1] < at[1:]
    starts, ends = at[:-1][some], at[1:][some] - 1
    first[starts], last[ends] = ~space[starts], ~space[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    keys = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + PIECE, "right")))
        low, high = int(s[i]), int(e[j - 1])
        power, inverse = _tables() if high - low <= 2 * PIECE else (_powers(_BASE, high - low), _powers(_INVERSE, high - low))
        x = _BYTE[body[low:high]]
        x *= power[: high - low]
        total = np.cumsum(x)
        a, b = s[i:j] - low, e[i:j] - low - 1
        keys[i:j] = (total[b] - total[a] + x[a]) * inverse[a]
        i = j
    size = e - s
    ending = body[e - 1].astype(np.uint32)
    for k in (2, 3):
        ending |= np.where(size >= k, body[np.maximum(e - k, 0)], 0).astype(np.uint32) << np.uint32(8 * (k - 1))
    ending = (ending * np.uint32(2654435761)) ^ (ending >> np.uint32(7))
    return mix(keys), ending, np.diff(np.searchsorted(s, at))
