"""Alignment of word sequences by longest matching blocks, for a batch of pairs at once.

The longest run of equal words is a block (the one that starts first in the reference, then in
the hypothesis, of equals); what lies before it on both sides, and what lies behind it, is
aligned likewise. A word that makes up more than a hundredth of a hypothesis of 200 words or
more starts no block, but extends one that it adjoins.

All pairs of a batch go through the levels of this recursion together. Equal words are listed
once as maximal runs along diagonals. On each level every window takes its best run as a block,
and the other runs are cut to the two windows that the block leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A word is popular in a hypothesis of at least POPULAR_FROM words if it occurs over n // POPULAR_SHARE + 1 times.
POPULAR_FROM, POPULAR_SHARE = 200, 100
#: Equal pairs of words that are listed at once; a pair of texts with more stands alone.
MATCHES = 1 << 18
#: Words of both sides that are aligned at once; a longer pair stands alone. So memory hardly depends on the batch.
PIECE = 1 << 16


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in the group) of each of the counted things."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


@dataclass
class Words:
    """Numbered words of many texts; text t has those from first[t] up to first[t + 1]."""

    word: np.ndarray
    first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


class Runs:
    """Maximal runs of equal words: window, i and j of the first, and size."""

    def __init__(self, window: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray):
        self.window, self.i, self.j, self.size = window, i, j, size

    def best(self) -> np.ndarray:
        """Index of each window's longest run, of the least i, then j, among equals."""
        order = np.lexsort((self.j, self.i, -self.size, self.window))
        return order[np.unique(self.window[order], return_index=True)[1]]


def _index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, places in their order, start and count of each key's places)."""
    order = np.argsort(keys, kind="stable")
    distinct, start, count = np.unique(keys[order], return_index=True, return_counts=True)
    return distinct, order, start, count


def _met(keys: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, count) of the places of each key, count 0 of an unknown one."""
    distinct, _, start, count = index
    if not len(distinct):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
    hit = distinct[at] == keys
    return np.where(hit, start[at], 0), np.where(hit, count[at], 0)


def _runs(ref_at: np.ndarray, hyp_at: np.ndarray, text: np.ndarray) -> Runs:
    """Maximal runs of equal words, from all equal pairs (places in the batch, and their text)."""
    diagonal = hyp_at - ref_at
    order = np.lexsort((ref_at, diagonal, text))
    i, d, t = ref_at[order], diagonal[order], text[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    heads = np.flatnonzero(new)
    return Runs(t[heads], i[heads], i[heads] + d[heads], np.diff(np.append(heads, len(i))))


def _blocks(ref: Words, hyp: Words, lo: int, hi: int, index: tuple, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, i, j, size) of the blocks of texts lo..hi - 1, level by level; places are those in the batch."""
    at = np.arange(ref.first[lo], ref.first[hi])
    near, nth = _spread(count[at])
    hyp_at = index[1][start[at][near] + nth]
    runs = _runs(at[near], hyp_at, np.searchsorted(ref.first, at[near], "right") - 1)
    text = np.arange(lo, hi)
    a, b, c, d = ref.first[lo:hi], ref.first[lo + 1 : hi + 1], hyp.first[lo:hi], hyp.first[lo + 1 : hi + 1]
    runs.window = runs.window - lo
    while len(text):
        i, j, size = a.copy(), c.copy(), np.zeros(len(text), np.int64)
        best = runs.best()
        own = runs.window[best]
        i[own], j[own], size[own] = runs.i[best], runs.j[best], runs.size[best]
        # A block takes in equal words that it adjoins: popular ones, which are in no run.
        alive = np.arange(len(text))
        while len(alive := alive[(i[alive] > a[alive]) & (j[alive] > c[alive])]):
            alive = alive[ref.word[i[alive] - 1] == hyp.word[j[alive] - 1]]
            i[alive] -= 1
            j[alive] -= 1
            size[alive] += 1
        alive = np.arange(len(text))
        while len(alive := alive[(i[alive] + size[alive] < b[alive]) & (j[alive] + size[alive] < d[alive])]):
            alive = alive[ref.word[i[alive] + size[alive]] == hyp.word[j[alive] + size[alive]]]
            size[alive] += 1
        found = np.flatnonzero(size)
        yield text[found], i[found], j[found], size[found]
        # The next level's windows, before and behind each block: numbers 2f and 2f + 1.
        number = np.full(len(text), -1)
        number[found] = np.arange(len(found))
        left_i, left_j, right_i, right_j = i[found], j[found], i[found] + size[found], j[found] + size[found]
        both = lambda x, y: np.stack([x, y], 1).reshape(-1)
        text, a, b, c, d = np.repeat(text[found], 2), both(a[found], right_i), both(left_i, b[found]), both(c[found], right_j), both(left_j, d[found])
        of = number[runs.window]
        before = np.minimum(runs.size, np.minimum(left_i[of] - runs.i, left_j[of] - runs.j))
        skip = np.maximum(0, np.maximum(right_i[of] - runs.i, right_j[of] - runs.j))
        behind = runs.size - skip
        head, tail = np.flatnonzero(before > 0), np.flatnonzero((before <= 0) & (behind > 0))
        runs = Runs(np.concatenate([2 * of[head], 2 * of[tail] + 1]), np.concatenate([runs.i[head], (runs.i + skip)[tail]]), np.concatenate([runs.j[head], (runs.j + skip)[tail]]), np.concatenate([before[head], behind[tail]]))
        # Windows without a word on one side are done.
        open_ = np.flatnonzero((a < b) & (c < d))
        number = np.full(len(text), -1)
        number[open_] = np.arange(len(open_))
        text, a, b, c, d = text[open_], a[open_], b[open_], c[open_], d[open_]
        runs.window = number[runs.window]


def matching_blocks(ref: Words, hyp: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, i, j, size) of all blocks in the order of the texts; i and j are places in the batch."""
    texts = len(ref.first) - 1
    if not texts:
        return (np.zeros(0, np.int64),) * 4
    known = int(max(ref.word.max(initial=-1), hyp.word.max(initial=-1))) + 1
    key = lambda w: np.repeat(np.arange(texts), w.count()) * known + w.word
    hyp_key, n = key(hyp), hyp.count()
    index = _index(hyp_key)
    distinct, order, start, count = index
    long = n[distinct // known] if known else n[:0]
    popular = (long >= POPULAR_FROM) & (count > long // POPULAR_SHARE + 1)
    start, count = _met(key(ref), (distinct, order, start, np.where(popular, 0, count)))
    total = np.concatenate([[0], np.cumsum(count)])[ref.first]  # equal pairs before each text
    out, lo = [], 0
    while lo < texts:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + MATCHES, "right")) - 1)
        out += list(_blocks(ref, hyp, lo, hi, index, start, count))
        lo = hi
    text, i, j, size = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((i, text))
    return text[order], i[order], j[order], size[order]


def _texts(column: pa.ListArray, words: pa.DictionaryArray, at: int) -> Words:
    first = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return Words(words.indices.to_numpy(zero_copy_only=False)[at : at + first[-1]].astype(np.int64), first)


def errors(ref: pa.ListArray, hyp: pa.ListArray) -> pa.ListArray:
    """For each pair the errors (type, ref, hyp, ref_pos, hyp_pos) in the order of the texts; null where a side is null. A null word counts as an empty one."""
    before = np.concatenate([[0], np.cumsum(sum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ref, hyp)))])
    out, lo = [], 0
    while lo < len(ref):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PIECE, "right")) - 1)
        out.append(_errors(ref.slice(lo, hi - lo), hyp.slice(lo, hi - lo)))
        lo = hi
    return pa.concat_arrays(out) if out else _errors(ref, hyp)


def _errors(ref: pa.ListArray, hyp: pa.ListArray) -> pa.ListArray:
    both = pa.concat_arrays([x.flatten().cast(pa.string()).fill_null("") for x in (ref, hyp)]).dictionary_encode()
    r = _texts(ref, both, 0)
    h = _texts(hyp, both, int(r.first[-1]))
    null = np.asarray(ref.is_null()) | np.asarray(hyp.is_null())
    text, i, j, size = matching_blocks(r, h)
    # Gaps: before each block and, with an empty block at its end, behind each text's last.
    texts = np.arange(len(null))
    text, i, j, size = (np.concatenate(x) for x in ((text, texts), (i, r.first[1:]), (j, h.first[1:]), (size, np.zeros(len(null), np.int64))))
    order = np.lexsort((size == 0, j, i, text))
    text, i, j, size = text[order], i[order], j[order], size[order]
    opens = np.ones(len(text), bool)
    opens[1:] = text[1:] != text[:-1]
    from_i, from_j = r.first[text], h.first[text]
    from_i[1:] = np.where(opens[1:], from_i[1:], (i + size)[:-1])
    from_j[1:] = np.where(opens[1:], from_j[1:], (j + size)[:-1])
    p, q = i - from_i, j - from_j
    gap, k = _spread(np.where(null[text], 0, np.maximum(p, q)))
    in_ref, in_hyp = k < p[gap], k < q[gap]
    ref_at, hyp_at = from_i[gap] + k, from_j[gap] + k
    own = text[gap]
    said = lambda w, at, on: both.dictionary.take(pa.array(np.where(on, w.word[np.minimum(at, max(len(w.word) - 1, 0))] if len(w.word) else 0, 0), mask=~on)).fill_null("")
    place = lambda w, at, on: pa.array((at - w.first[own]).astype(np.int32), mask=~on)
    kind = pa.array(["substitution", "deletion", "insertion"]).take(pa.array(np.where(in_ref & in_hyp, 0, np.where(in_ref, 1, 2))))
    rows = pa.StructArray.from_arrays([kind, said(r, ref_at, in_ref), said(h, hyp_at, in_hyp), place(r, ref_at, in_ref), place(h, hyp_at, in_hyp)], names=["type", "ref", "hyp", "ref_pos", "hyp_pos"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(null)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(null, False)), rows)
