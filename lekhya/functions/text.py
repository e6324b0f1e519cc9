"""Text functions of columns: normal forms, tests, tokens. All run in the JVM but nfc()."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lekhya import lexicon as lx
from lekhya.functions.once import let

#: Letters ranges of the scripts that filters count; a script is a parameter of the operators.
SCRIPTS = {"devanagari": "\\u0900-\\u097F", "latin": "A-Za-z\\u00C0-\\u024F"}
SPACE = r"(?U)\s+"


@pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Kept apart from what is computed of it: a Python function cannot run inside a lambda, where a merged projection would put it.
_nfc = _nfc.asNondeterministic()


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no such function: an Arrow function, one pass a batch."""
    return _nfc(text)


def nfc_native(text: Column) -> Column:
    """NFC of text whose only combining marks are Devanagari; evaluated in the JVM, and only on rows that have such marks."""
    split = {chr(c): unicodedata.normalize("NFC", chr(c)) for c in range(0x0958, 0x0960)}
    join = {unicodedata.normalize("NFD", chr(c)): chr(c) for c in (0x0929, 0x0931, 0x0934)}
    changed = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), (split | join).items(), text)
    return F.when(text.rlike("[\\u0958-\\u095F\\u093C]"), changed).otherwise(text)


def _where(text: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """change(text) where a cheap test says that it may differ from text, else text."""
    return let(text, lambda t: F.when(test(t), change(t)).otherwise(t))


def strip(text: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)).rlike(r"(?U)\s")
    return _where(text, ends, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))


def single_spaces(text: Column) -> Column:
    """Runs of plain spaces as one."""
    return _where(text, lambda t: F.contains(t, F.lit("  ")), lambda t: F.regexp_replace(t, " {2,}", " "))


def normalize_text(text: Column, compose=nfc) -> Column:
    """Trimmed, composed, runs of plain spaces as one."""
    return single_spaces(compose(strip(text)))


def normalize_for_wer(text: Column, compose=nfc, single: bool = True) -> Column:
    """The form in which transcripts are compared: composed, runs of danda or period as one danda, none of them at the end, single spaces (if single)."""
    runs = lambda t: reduce(Column.__or__, [F.contains(t, F.lit(x + y)) for x in (lx.DANDA, ".") for y in (lx.DANDA, ".")])
    marked = _where(compose(text), runs, lambda t: F.regexp_replace(t, f"[{lx.DANDA}.]{{2,}}", lx.DANDA))
    ends = lambda t: F.substring(t, -1, 1).isin(lx.DANDA, ".", " ", "\n", "\r", "\u0085", "\u2028", "\u2029")
    tail = strip(_where(marked, ends, lambda t: F.regexp_replace(t, f"[{lx.DANDA}. ]+$", "")))
    return single_spaces(tail) if single else tail


def tokens(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def count_script(text: Column, script: str = "devanagari") -> Column:
    """Code points of a script, combining marks included."""
    return F.length(F.regexp_replace(text, f"[^{SCRIPTS[script]}]", ""))


def is_punctuation_only(text: Column) -> Column:
    """No letter and no digit; true of an empty text."""
    return ~text.rlike(r"[\p{L}\p{Nd}]")


def strip_edges(text: Column, marks: str) -> Column:
    return F.btrim(text, F.lit(marks))


def strip_tail(text: Column, marks: str) -> Column:
    return F.regexp_replace(text, "[" + "".join(f"\\u{ord(c):04X}" for c in marks) + "]+$", "")


def is_filler(text: Column, fillers: Sequence[str] = lx.SEGMENT_FILLERS) -> Column:
    """The whole text, less final danda and periods, is a filler."""
    return strip_tail(strip(text), lx.DANDA + ".").isin(*fillers)


def has_roman(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def is_title(text: Column) -> Column:
    """Every run of cased letters begins with its only capital; false without any."""
    return text.rlike(r"^[^\p{Lu}\p{Lt}\p{Ll}]*(?:[\p{Lu}\p{Lt}]\p{Ll}*[^\p{Lu}\p{Lt}\p{Ll}]+)*[\p{Lu}\p{Lt}]\p{Ll}*[^\p{Lu}\p{Lt}\p{Ll}]*$")


def rewrite_prefix(url: Column, old: str, new: str) -> Column:
    """url with its prefix old replaced, or as it is."""
    return F.when(F.startswith(url, F.lit(old)), F.concat(F.lit(new), F.substring(url, len(old) + 1, 1 << 30))).otherwise(url)


def tallies(words: Column) -> Column:
    """(word, n, first) of each distinct word: how often it occurs, and where first. Words are sorted with their places, and cut into runs of equal ones."""

    def counted(s: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, F.greatest(i - 1, F.lit(0)))["w"])
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), new)
        entry = lambda hs, at, k: F.struct(F.get(s, at)["w"].alias("word"), (F.coalesce(F.get(hs, k + 1), F.size(s)) - at).alias("n"), F.get(s, at)["i"].alias("first"))
        return F.when(F.size(s) > 0, let(heads, lambda hs: F.transform(hs, lambda at, k: entry(hs, at, k))))

    return let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), counted)


def most_repeats(words: Column) -> Column:
    """How often the most frequent word occurs; 0 of none."""
    return F.coalesce(F.array_max(F.transform(tallies(words), lambda t: t["n"])), F.lit(0))


def repeats(words: Column, least: int) -> Column:
    """Whether some word occurs `least` times: equal words of a sorted array stand together."""
    far = lambda s: F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - least + 1, F.lit(0))), F.slice(s, least, F.greatest(F.size(s) - least + 1, F.lit(0))), lambda a, b: a == b)
    return F.coalesce(let(F.array_sort(words), lambda s: F.exists(far(s), lambda x: x)), F.lit(False))


def most_frequent(words: Column) -> Column:
    """(word, n) of the most frequent word, the first seen of equals; null of none."""
    ranked = F.transform(tallies(words), lambda t: F.struct(t["n"].alias("n"), (-t["first"]).alias("last"), t["word"].alias("word")))
    return let(F.array_max(ranked), lambda t: F.when(t.isNotNull(), F.struct(t["word"].alias("word"), t["n"].alias("n"))))


def collapse_repeats(text: Column, least: int = lx.REPAIR_REPEATS) -> Column:
    """Runs of at least `least` equal words as one word."""
    return strip(F.regexp_replace(F.regexp_replace(text, rf"(?<!\S)(\S+)(?:\s+\1){{{least - 1},}}(?!\S)", "$1"), " {2,}", " "))


def strip_inflection(word: Column, suffixes: Sequence[str] = lx.SUFFIXES) -> Column:
    """Without its longest listed ending, if over two letters remain."""
    out = word
    for s in sorted(suffixes, key=len):
        out = F.when(F.endswith(word, F.lit(s)) & (F.length(word) > len(s) + 2), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


def borrowed_score(word: Column, marks: Sequence[str] = lx.BORROWED_MARKS) -> Column:
    """Marks of a borrowed word, at most 3."""
    return F.least(reduce(Column.__add__, [word.rlike(m).cast("int") for m in marks]), F.lit(3))


def fixed(value: Column, places: int) -> Column:
    """A number written with so many places, from 1 to 8, rounded half to even by its exact binary value, below 2^53.

    The fraction is taken apart into two whole numbers of 40 bits each, which hold every bit that
    can decide, and rounded as a decimal.
    """
    half = 1 << 79
    size = F.abs(value.cast("double"))
    whole = F.floor(size)
    high = let(size - whole, lambda f: F.struct(F.floor(f * float(1 << 40)).alias("h"), f.alias("f")))
    exact = lambda n: n.cast("decimal(20,0)")

    def rounded(p: Column) -> Column:
        low = F.floor((p["f"] * float(1 << 40) - p["h"]) * float(1 << 40))
        scaled = ((exact(p["h"]) * F.lit(Decimal(1 << 40)) + exact(low)).cast("decimal(25,0)") * F.lit(Decimal(10**places))).cast("decimal(38,0)")
        return let(scaled, lambda q: let(F.call_function("div", q, F.lit(Decimal(2 * half))).cast("bigint"), lambda k: F.struct(k.alias("k"), (q - k.cast("decimal(20,0)") * F.lit(Decimal(2 * half))).alias("rest"))))

    up = lambda r: r["k"] + F.when((r["rest"] > F.lit(Decimal(half))) | ((r["rest"] == F.lit(Decimal(half))) & (r["k"] % 2 == 1)), 1).otherwise(0)
    total = whole.cast("bigint") * 10**places + let(let(high, rounded), up)
    digits = let(total, lambda t: F.concat(F.call_function("div", t, F.lit(10**places)).cast("string"), F.lit("."), F.lpad((t % 10**places).cast("string"), places, "0")))
    return F.concat(F.when(value < 0, "-").otherwise(""), digits)
