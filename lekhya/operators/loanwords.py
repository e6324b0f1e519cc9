"""English loanwords in Devanagari."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lekhya import lexicon as lx
from lekhya.functions import text
from lekhya.functions.once import let


def is_loanword(word: Column, enough: int = 2) -> Column:
    """A listed loanword, inflected or not, or a word with enough marks of borrowing and no native ending; never a listed native word."""
    return let(text.strip_edges(word, lx.TAGGER_EDGES), lambda core: _judge(core, enough))


def _judge(core: Column, enough: int) -> Column:
    native_end = reduce(Column.__or__, [F.endswith(core, F.lit(e)) for e in lx.NATIVE_ENDINGS])
    return F.coalesce(
        F.when((text.count_script(core) == 0) | core.isin(*lx.NATIVE_WORDS), False)
        .when(core.isin(*lx.LOANWORDS) | text.strip_inflection(core).isin(*lx.LOANWORDS), True)
        .when(native_end, False)
        .otherwise(text.borrowed_score(core) >= enough),
        F.lit(False),
    )


def tag(sentence: Column) -> Column:
    """struct(text, words, positions, n): loanwords between [EN] and [/EN], marks around them kept outside."""
    edges = "".join(f"\\u{ord(c):04X}" for c in lx.TAGGER_EDGES)
    raw = text.tokens(sentence)
    found = F.transform(raw, lambda w, i: F.struct(w.alias("w"), i.alias("i"), text.strip_edges(w, lx.TAGGER_EDGES).alias("core"), is_loanword(w).alias("en")))
    shown = lambda s: F.when(s["en"], F.concat(F.regexp_extract(s["w"], f"^[{edges}]*", 0), F.lit("[EN]"), s["core"], F.lit("[/EN]"), F.regexp_extract(s["w"], f"[{edges}]*$", 0))).otherwise(s["w"])
    return let(found, lambda all_words: _tagged(all_words, shown))


def _tagged(words: Column, shown: Callable[[Column], Column]) -> Column:
    on = F.filter(words, lambda s: s["en"])
    return F.struct(F.array_join(F.transform(words, shown), " ").alias("text"), F.transform(on, lambda s: s["core"]).alias("words"), F.transform(on, lambda s: s["i"]).alias("positions"), F.size(on).alias("n"))
