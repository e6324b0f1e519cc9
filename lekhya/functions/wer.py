"""Word edits and alignment of transcripts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from lekhya.functions import blocks, distance
from lekhya.functions.once import let

#: Characters of texts whose whole distance table is made at once, and distinct words of pairs that are numbered by looking each up.
SHORT, DISTINCT = 256, 255
#: Of longer texts: the first band of the table, beside the difference of lengths; how much wider each next one is; and how many are tried before the whole table.
BAND, WIDER, TRIES = 64, 4, 5
ERROR = "struct<type:string,ref:string,hyp:string,ref_pos:int,hyp_pos:int>"
_FIELDS = StructType().add("type", StringType()).add("ref", StringType()).add("hyp", StringType()).add("ref_pos", IntegerType()).add("hyp_pos", IntegerType())


def _unlike(p: Column) -> Column:
    """The words of p.r and p.h without the equal ones that both begin with, then without those that both end with."""

    def rest(q: Column, turned: bool) -> Column:
        n = F.least(F.size(q["r"]), F.size(q["h"]))
        same = F.zip_with(F.slice(q["r"], F.lit(1), n), F.slice(q["h"], F.lit(1), n), lambda a, b: a == b)
        cut = let(F.array_position(same, F.lit(False)).cast("int"), lambda at: F.when(at > 0, at - 1).otherwise(n))
        flip = F.reverse if turned else lambda x: x
        left = lambda c, k: flip(F.slice(q[c], k + 1, F.size(q[c])))
        return let(cut, lambda k: F.struct(left("r", k).alias("r"), left("h", k).alias("h")))

    return let(let(rest(p, False), lambda q: F.struct(F.reverse(q["r"]).alias("r"), F.reverse(q["h"]).alias("h"))), lambda q: rest(q, True))


def _numbered(p: Column) -> Column:
    """Numbers of the words of p.r and p.h in one array, equal words alike: words are sorted with their places, numbered by runs, and sorted back."""

    def runs(s: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, F.greatest(i - 1, F.lit(0)))["w"])
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), new)
        run = lambda hs, at, k: F.slice(s, at + 1, F.coalesce(F.get(hs, k + 1), F.size(s)) - at)
        return let(heads, lambda hs: F.flatten(F.transform(hs, lambda at, k: F.transform(run(hs, at, k), lambda x: F.struct(x["i"].alias("i"), k.alias("k"))))))

    words = F.transform(F.concat(p["r"], p["h"]), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return F.transform(F.sort_array(let(F.sort_array(words), runs)), lambda x: x["k"])


def _spelled(numbers: Column) -> Column:
    """A text of a character for each number, surrogates left out; there are 1.1 million characters."""
    code = lambda k: F.lpad(F.hex(k + F.when(k >= 0xD700, 0x900).otherwise(0x100)), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(numbers, code), "")), "UTF-32")


def unlike(ref: Column, hyp: Column) -> Column:
    """struct(r, h): two arrays of words without the equal words at both ends; null where one is null."""
    return F.when(ref.isNotNull() & hyp.isNotNull(), let(F.struct(ref.alias("r"), hyp.alias("h")), _unlike))


def _letters(p: Column) -> Column:
    """struct(r, h): texts of a character for each word of p.r and p.h, equal words alike."""

    def looked_up(q: Column) -> Column:
        spell = lambda words: F.array_join(F.transform(words, lambda w: F.char(F.array_position(q["known"], w))), "")
        return F.struct(spell(q["r"]).alias("r"), spell(q["h"]).alias("h"))

    def sorted_(q: Column) -> Column:
        m = F.size(q["r"])
        return let(_numbered(q), lambda k: F.struct(_spelled(F.slice(k, F.lit(1), m)).alias("r"), _spelled(F.slice(k, m + 1, F.size(q["h"]))).alias("h")))

    known = F.struct(p["r"].alias("r"), p["h"].alias("h"), F.array_distinct(F.concat(p["r"], p["h"])).alias("known"))
    return let(known, lambda q: F.when(F.size(q["known"]) <= DISTINCT, looked_up(q)).otherwise(sorted_(q)))


def unlike_edits(p: Column) -> Column:
    """Least number of word edits between p.r and p.h, in the JVM: each distinct word becomes a character, Levenshtein does the rest.

    The distance of longer texts is looked for in bands about the diagonal, from the difference
    of lengths on, each WIDER times the last. Cost: that of sorting the words, and a square of
    the length, small up to some thousands of words. 1.1 million distinct words at most; more is
    an error.
    """

    def table(s: Column) -> Column:
        apart = F.greatest(F.abs(F.length(s["r"]) - F.length(s["h"])), F.lit(BAND))
        banded = [F.nullif(F.call_function("levenshtein", s["r"], s["h"], apart * WIDER**i), F.lit(-1)) for i in range(TRIES)]
        whole = F.levenshtein(s["r"], s["h"])
        return F.when(F.greatest(F.length(s["r"]), F.length(s["h"])) <= SHORT, whole).otherwise(F.coalesce(*banded, whole))

    longer, shorter = F.greatest(F.size(p["r"]), F.size(p["h"])), F.least(F.size(p["r"]), F.size(p["h"]))
    return F.when(p.isNotNull(), F.when(shorter == 0, longer).otherwise(let(_letters(p), table)))


@arrow_udf(IntegerType())
def long_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The same for texts of any length, at the cost of the length and of the edits squared where these are few, else of the table in bits. An Arrow function."""
    return distance.edits(ref, hyp)


def word_edits(ref: Column, hyp: Column) -> Column:
    """Least number of word edits between two arrays of words of any length; null where one is null. Unequal arrays go to an Arrow function: lambdas of columns took five times as long at 84 words."""
    apart = ref != hyp
    return F.when(ref == hyp, F.lit(0)).otherwise(long_edits(F.when(apart, ref), F.when(apart, hyp)))


def wer(edits: Column, ref_words: Column) -> Column:
    """Edits per reference word; 0 for a blank reference."""
    return F.when(ref_words > 0, edits / ref_words).otherwise(F.lit(0.0))


@arrow_udf(ArrayType(_FIELDS))
def word_errors(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Differences of two arrays of words, aligned by longest matching blocks: spans are paired word by word, what is left over is deleted or inserted.

    This alignment is not one of least edits. An Arrow function: no built-in aligns. A null side gives null.
    """
    return blocks.errors(ref, hyp)


def block_wer(errors: Column, ref_words: Column) -> Column:
    """The rate by word_errors: of each unequal span the words of its longer side, per reference word (1 for a blank reference). It may exceed the least rate."""
    return F.size(errors) / F.greatest(ref_words, F.lit(1))


def outcome(before: Column, after: Column, changed: Column) -> Column:
    """What a repair did to a text, by unrounded word error rates."""
    return F.when(~changed, "unchanged").when(after < before, "improved").when(after > before, "regressed").otherwise("unchanged_wer")
