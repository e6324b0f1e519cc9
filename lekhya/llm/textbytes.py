"""Vectorised work on UTF-8 text held in Arrow buffers: words, hashes, shingles, reductions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_MUL = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def trim() -> None:
    """Hand memory that large arrays left behind back to the system: a worker that waits for its next task keeps little."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each; a longer row stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of inside), and the index of each row's first word."""
    inside = ~WHITE[raw] if inside is None else inside
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    cut = offsets[:-1][offsets[:-1] < len(raw)]
    first = before.copy()
    first[cut] = False
    starts = np.flatnonzero(inside & ~first[:-1])
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = inside
    after[cut] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _MUL if kind == "up" else pow(_MUL, -1, 1 << 64)
        step = np.full(max(n, 1 << 20), base, U)
        step[0] = 1
        if n > 4 << 20:  # one very long text: not kept
            return np.cumprod(step, dtype=U)
        _powers[kind] = np.cumprod(step, dtype=U)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ x >> U(30)
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span, mixed."""
    if not len(starts):
        return np.zeros(0, U)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * _power("up", len(raw)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", len(raw))[starts] + (ends - starts).astype(U) * _P3)


def shingle_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, index of each row's first shingle): all k-word windows, or one for a shorter row."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(first[-1]) - first[:-1][row]
    ok = (at <= n[row] - k) | ((n[row] < k) & (at == 0))
    i = np.flatnonzero(ok)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    return i, np.minimum(i + k, first[1:][row[i]]) - 1, np.concatenate([[0], np.cumsum(count)])


def shingle_hashes(words: np.ndarray, i: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..last, each at most k words."""
    h = np.zeros(len(i), U)
    for t in range(k):
        on = i + t <= last
        at = np.minimum(i + t, last)
        h = np.where(on, h * U(_MUL) + words[at], h) if not on.all() else h * U(_MUL) + words[at]
    return mix(h)


def joined(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in which the words of a row are separated by one space, with the words' new places."""
    white = WHITE[raw]
    kept = ~white
    kept[ends[ends < len(raw)]] = True  # the byte after a word: white space, or the next row's first word
    place = np.cumsum(kept) - 1
    out = np.where(white, np.uint8(32), raw)[kept]
    return out, place[starts] if len(starts) else starts, place[ends - 1] + 1 if len(ends) else ends


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span, in groups of equal length; spans over 256 bytes one by one."""
    out = np.zeros(len(starts), U)
    size = (ends - starts).astype(np.int64)
    data = np.concatenate([raw, np.zeros(8, np.uint8)])
    w8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    w4 = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    order = np.argsort(np.minimum(size, 300).astype(np.uint16), kind="stable")
    bounds = np.flatnonzero(np.diff(np.minimum(size, 300)[order], prepend=-1))
    for a, b in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
        rows = order[a:b]
        n, p = int(size[rows[0]]), starts[rows]
        if n > 256:
            for r in rows:
                out[r] = xxhash.xxh64_intdigest(data[starts[r] : ends[r]].tobytes(), seed)
            continue
        at = 0
        if n >= 32:
            v = [U((seed + int(_P1) + int(_P2)) & (1 << 64) - 1), U((seed + int(_P2)) & (1 << 64) - 1), U(seed), U((seed - int(_P1)) & (1 << 64) - 1)]
            v = [np.full(len(rows), x, U) for x in v]
            while at + 32 <= n:
                for lane in range(4):
                    v[lane] = _rot(v[lane] + w8[p + at + 8 * lane] * _P2, 31) * _P1
                at += 32
            h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for x in v:
                h = (h ^ _rot(x * _P2, 31) * _P1) * _P1 + _P4
        else:
            h = np.full(len(rows), U(seed) + _P5, U)
        h = h + U(n)
        while at + 8 <= n:
            h = _rot(h ^ _rot(w8[p + at] * _P2, 31) * _P1, 27) * _P1 + _P4
            at += 8
        if at + 4 <= n:
            h = _rot(h ^ w4[p + at].astype(U) * _P1, 23) * _P2 + _P3
            at += 4
        while at < n:
            h = _rot(h ^ data[p + at].astype(U) * _P5, 11) * _P1
            at += 1
        h = (h ^ h >> U(33)) * _P2
        h = (h ^ h >> U(29)) * _P3
        out[rows] = h ^ h >> U(32)
    return out


def bit_majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row, the bits set in over half of its hashes; 0 for a row without any."""
    n = np.diff(first)
    out = np.zeros(len(n), U)
    full = np.flatnonzero(n > 0)
    if len(full):
        bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1)
        total = np.zeros((len(full), 64), np.int32)
        step = 60_000
        for a in range(0, len(bits), step):  # prefix sums of small blocks stay in the cache
            b = min(len(bits), a + step)
            lo, hi = np.searchsorted(first[1:][full], a, "right"), np.searchsorted(first[:-1][full], b, "left")
            cuts = np.maximum(first[:-1][full[lo:hi]], a) - a
            total[lo:hi] += np.add.reduceat(bits[a:b], cuts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * total > n[full][:, None], axis=1).view(U)[:, 0]
    return out
