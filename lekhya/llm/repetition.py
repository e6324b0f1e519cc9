"""Quality rules on repetition: characters inside duplicated n-grams and lines, by rolling hashes in numpy.

The hash of an n-gram rolls on from that of the n-gram one word shorter at the same place. Only
places at which the shorter n-gram, and the one after it, are duplicated can begin a duplicated
longer one, so each length looks at what the last one left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.llm import textbytes as tb

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
LEAST_WORDS, MOST_REPEATED_PCT = 50, 50
#: Words in the windows of the base rule.
WINDOW = 3
_NEXT = tb.U(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Limits:
    """Largest shares, of a text's characters in words, that its kept texts have; lines is the share of lines.

    top is by length of the n-gram: characters in all occurrences of the one that has most in them.
    duplicated is by length: characters in any n-gram that occurs twice or more, each counted once.
    The usual limits of the latter (0.15 for five words to 0.10 for ten) hold where first occurrences
    do not count; here they do, so the limits are twice as high.
    """

    symbols_per_word: float = 0.1
    duplicate_lines: float = 0.3
    duplicate_line_chars: float = 0.2
    top: tuple[tuple[int, float], ...] = ((2, 0.2), (3, 0.18), (4, 0.16))
    duplicated: tuple[tuple[int, float], ...] = ((5, 0.30), (6, 0.28), (7, 0.26), (8, 0.24), (9, 0.22), (10, 0.20))


def characters(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all."""
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=total[1:])
    return total


def groups(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each, size of each number): equal hashes of one row share a number."""
    keys = tb.mix(h ^ tb.mix(row.astype(tb.U) + tb.U(1)))
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (row[order][1:] != row[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, np.bincount(number, minlength=int(new.sum()))


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total words lie in a window of n words from one of the places at."""
    edge = np.bincount(at, minlength=total + 1) - np.bincount(np.minimum(at + n, total), minlength=total + 1)
    return np.cumsum(edge[:total]) > 0


def measures(raw: np.ndarray, offsets: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """The measures of each row of UTF-8 bytes, by name."""
    rows = len(offsets) - 1
    starts, ends, first = tb.spans(raw, offsets)
    chars = characters(raw)
    size = chars[ends] - chars[starts]
    n_words = np.diff(first)
    before = np.concatenate([[0], np.cumsum(size)])
    per_row = lambda values, cut: (lambda t: t[cut[1:]] - t[cut[:-1]])(np.concatenate([[0], np.cumsum(values)]))
    out = {"n_words": n_words, "word_chars": per_row(size, first), "n_symbols": per_row(SYMBOLS[raw], offsets)}

    # Lines: pieces between newlines and row ends; one counts if it holds a word.
    breaks = np.flatnonzero(raw == 10)
    heads = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    heads = heads[heads < len(raw)]
    tails = np.append(heads[1:], len(raw))
    tails = np.where(raw[tails - 1] == 10, tails - 1, tails) if len(heads) else tails[:0]
    full = np.searchsorted(starts, tails, "left") > np.searchsorted(starts, heads, "left")
    heads, tails = heads[full], tails[full]
    of = np.searchsorted(offsets, heads, "right") - 1
    number, _ = groups(of, tb.word_hashes(raw, heads, tails))
    again = np.ones(len(heads), bool)
    again[np.unique(number, return_index=True)[1]] = False
    line_chars = before[np.searchsorted(starts, tails, "left")] - before[np.searchsorted(starts, heads, "left")]
    cut = np.searchsorted(of, np.arange(rows + 1), "left")
    out |= {"n_lines": np.diff(cut), "n_dup_lines": per_row(again, cut), "dup_line_chars": per_row(line_chars * again, cut)}

    # n-grams: at holds the places that can still begin a duplicated one, h their hashes.
    row = np.repeat(np.arange(rows), n_words)
    left = first[1:][row] - np.arange(len(row))
    word = tb.word_hashes(raw, starts, ends)
    top, dup = dict(limits.top), dict(limits.duplicated)
    at, h = np.arange(len(row)), word
    for n in range(1, max([WINDOW, *top, *dup]) + 1):
        if n > 1:
            last = at + n - 1
            h = tb.mix(h * _NEXT + word[last])
        number, sizes = groups(row[at], h)
        twice = sizes[number] > 1 if len(number) else np.zeros(0, bool)
        if n in top:
            span = before[at + n] - before[at]
            most = np.zeros(rows, np.int64)
            np.maximum.at(most, row[at[twice]], (span * sizes[number])[twice] if len(number) else span)
            out[f"top_{n}gram_chars"] = most
        if n == WINDOW or n in dup:
            inside = covered(at[twice], n, len(row))
            if n == WINDOW:
                out["n_repeat_words"] = per_row(inside, first)
            if n in dup:
                out[f"dup_{n}gram_chars"] = per_row(size * inside, first)
        # The next length: the shorter n-gram is duplicated here and at the next word of the row.
        flag = np.zeros(len(row) + 1, bool)
        flag[at[twice]] = True
        on = twice & (left[at] > n) & flag[at + 1]
        at, h = at[on], h[on]
    return out


def measured(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, and the measures as longs) of every row, texts whole.

    n_words, word_chars (code points in words), n_symbols, n_lines (those with a word), n_dup_lines
    and dup_line_chars (equal to an earlier line of the text), n_repeat_words (words in windows
    of three that occur twice or more), top_Ngram_chars and dup_Ngram_chars. Null, empty and blank
    texts measure 0 throughout; a very long one is a batch of its own. Repeated rows give
    repeated results, null ids stay; other columns, whatever their names, are not read.
    """
    limits = limits or Limits()
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *[f"top_{n}gram_chars" for n, _ in limits.top], *[f"dup_{n}gram_chars" for n, _ in limits.duplicated]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tb.utf8(batch.column(1))
            for i, j in tb.pieces(offsets):
                got = measures(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], limits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(got[n].astype(np.int64)) for n in names]], names=["doc_id", *names])
        tb.trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in ["doc_id", *names]))


def broken_rules(limits: Limits) -> dict[str, Column]:
    """By name, whether a measured text breaks each rule of the limits."""
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("word_chars", "n_words", "n_lines"))
    rules = {
        "symbols": F.col("n_symbols") > limits.symbols_per_word * words,
        "duplicate_lines": F.col("n_dup_lines") > limits.duplicate_lines * lines,
        "duplicate_line_chars": F.col("dup_line_chars") > limits.duplicate_line_chars * chars,
    }
    rules |= {f"top_{n}gram": F.col(f"top_{n}gram_chars") > most * chars for n, most in limits.top}
    return rules | {f"dup_{n}gram": F.col(f"dup_{n}gram_chars") > most * chars for n, most in limits.duplicated}


def judge(docs: DataFrame, limits: Limits | None = None, least_words: int = LEAST_WORDS, most_repeated_pct: int = MOST_REPEATED_PCT) -> DataFrame:
    """measured(docs) with base_failed, broken (the names of the broken rules) and kept.

    base_failed: fewer than least_words words, or over most_repeated_pct percent of the words in
    repeated windows of three. kept: neither base_failed nor any rule broken. No shuffle.
    """
    limits = limits or Limits()
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_pct * F.col("n_words"))
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in broken_rules(limits).items()]), lambda x: x.isNotNull())
    out = measured(docs, limits).withColumns({"base_failed": failed, "broken": broken})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
