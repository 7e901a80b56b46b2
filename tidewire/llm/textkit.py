"""Vectorised tokenising and hashing of Arrow text columns with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}

#: Byte classes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = np.full(max(n, 1 << 21), _P if which == "up" else _P_INV, U)
        base[0] = 1
        _powers[which] = np.cumprod(base, dtype=U)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes that cover all rows; a longer text is a block of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def texts(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of a column: first row, last row, bytes, offsets."""
    data, offsets = utf8(column)
    for lo, hi in blocks(offsets, size):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are ``inside``, cut at row borders."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans hash equally wherever they stand."""
    if not len(start):
        return np.zeros(0, U)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=total[1:])
    return mix((total[end] - total[start]) * _power("down", len(data) + 1)[start] + U(0x632BE59BD9B4E019) * (end - start).astype(U))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Hash, row, start and end of each word of A-Z-lowered text; words are runs without ASCII white space, or of ``inside``."""
    data = LOWER[data]
    start, end, row = spans(~SPACE[data] if inside is None else inside[data], offsets)
    return span_hashes(data, start, end), row, start, end


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each place (n - 1 fewer places than words)."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, U(0xD6E8FEB86659FD93 + n), U)
    for k in range(n):
        out = mix(out * U(0xA0761D6478BD642F) + h[k : k + m])
    return out


def word_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each row; with fewer words the whole sequence is one, without words the set is empty."""
    h, row, _, _ = words(data, offsets)
    at = np.searchsorted(row, np.arange(len(offsets)))
    grams = ngrams(h, n)
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            out.append(ngrams(h[lo:hi], int(hi - lo)))
        else:
            out.append(np.zeros(0, U))
    return out
