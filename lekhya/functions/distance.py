"""Least word edits of long pairs, in one Python task at a time: exact, for a batch of word arrays."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: A word at more places than this keeps its mask; of texts of up to SMALL words, every word.
FREQUENT, SMALL = 64, 4096


def _follow(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many words are equal from places i and j on, looked at in pieces that double."""
    done, step, most = 0, 16, min(len(a) - i, len(b) - j)
    while done < most:
        n = min(step, most - done)
        unlike = a[i + done : i + done + n] != b[j + done : j + done + n]
        first = int(unlike.argmax())
        if unlike[first]:
            return done + first
        done, step = done + n, step * 2
    return most


def by_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edits if they are at most most: reach[k] is the furthest place in a on diagonal k (place in b less place in a) after so many edits."""
    apart = len(b) - len(a)
    if abs(apart) > most:
        return None
    reach = {0: _follow(a, b, 0, 0)}
    for edits in range(most + 1):
        if reach.get(apart, -1) >= len(a):
            return edits
        new = {}
        for k in range(-edits - 1, edits + 2):
            i = max(reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1, reach.get(k - 1, -2))
            i = min(i, len(a), len(b) - k)
            if i >= max(0, -k):
                new[k] = i + _follow(a, b, i, i + k)
        reach = new
    return None


def by_bits(a: np.ndarray, b: np.ndarray) -> int:
    """The edits by the rows of the distance table as two integers of a bit for each word of a: where the next cell is one more, and where one less."""
    n = len(a)
    masks: dict[int, int] = {}
    if n <= SMALL:
        for i, word in enumerate(a.tolist()):
            masks[word] = masks.get(word, 0) | 1 << i
        return _counted(n, [masks.get(word, 0) for word in b.tolist()])
    order = np.argsort(a, kind="stable")
    words, start, count = np.unique(a[order], return_index=True, return_counts=True)
    at = {int(w): order[s : s + c] for w, s, c in zip(words, start, count, strict=True)}

    def mask(word: int) -> int:
        if word in masks:
            return masks[word]
        places = at.get(word)
        if places is None:
            return 0
        bits = np.zeros(n // 8 + 1, np.uint8)
        np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        out = int.from_bytes(bits.tobytes(), "little")
        if len(places) > FREQUENT:
            masks[word] = out
        return out

    return _counted(n, map(mask, b.tolist()))


def _counted(n: int, masks: Iterable[int]) -> int:
    """The edits between a text of n words and another; masks has, for each word of that, the bits of its places in the former."""
    full, last = (1 << n) - 1, 1 << n - 1
    more, less, edits = full, 0, n
    for equal in masks:
        down = equal | less
        across = (((equal & more) + more) ^ more) | equal
        up = less | full & ~(across | more)
        gone = more & across
        if up & last:
            edits += 1
        elif gone & last:
            edits -= 1
        up = up << 1 & full | 1
        gone = gone << 1 & full
        more = gone | full & ~(down | up)
        less = up & down
    return edits


def edits(ref: pa.ListArray, hyp: pa.ListArray) -> pa.Array:
    """Least word edits of each pair, null where a side is null.

    The equal words at both ends are left out. Of texts of over SMALL words, up to the root of the
    length in edits are looked for along diagonals, at the cost of the length and of the edits
    squared; all else is counted by bits.
    """
    both = pa.concat_arrays([x.flatten().cast(pa.string()).fill_null("") for x in (ref, hyp)]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ends = [np.concatenate([[0], np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]) for x in (ref, hyp)]
    out: list[int | None] = []
    for t, there in enumerate((ref.is_valid().to_numpy(zero_copy_only=False) & hyp.is_valid().to_numpy(zero_copy_only=False)).tolist()):
        if not there:
            out.append(None)
            continue
        a, b = both[ends[0][t] : ends[0][t + 1]], both[ends[0][-1] + ends[1][t] : ends[0][-1] + ends[1][t + 1]]
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        same = _follow(a, b, 0, 0)
        a, b = a[same:], b[same:]
        same = _follow(a[::-1], b[::-1], 0, 0)
        a, b = a[: len(a) - same], b[: len(b) - same]
        few = len(b) if not len(a) else by_diagonals(a, b, math.isqrt(len(b))) if len(a) > SMALL else None
        out.append(by_bits(a, b) if few is None else few)
    return pa.array(out, pa.int32())
