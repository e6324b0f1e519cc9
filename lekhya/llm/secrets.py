"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhya.functions.once import let
from lekhya.llm.common import keep

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that have 24 characters
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: For each encoding: alphabet, and how far natural text is from uniform over it (chi-squared a character).
ENCODINGS = {
    "hex": ("0123456789abcdef", 0.6),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.2),
}
#: Lengths from which a class of candidates begins; each class has its own false-discovery control.
CLASSES = (20, 28, 40, 64, 128)
FALSE_DISCOVERY, BINS = 0.01, 20


#: Matches that are placed together: places in a text are found block by block, so a text of many matches costs their number, not its square.
BLOCK = 256


def spans(text: Column, pattern: str, on: Column, passes=None, group: int = 0) -> Column:
    """Array of (start, end, value) of a pattern's leftmost matches, in code points, end exclusive.

    The pieces between the matches, of a split by the same pattern, give the places. on is a
    cheap test that is true for every text with a match; passes drops matches by group.
    """
    found = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
    empty = F.lit([]).cast("array<struct<start:long,end:long,value:string>>")
    zero = F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))
        ok = x["m"].isNotNull() if passes is None else x["m"].isNotNull() & passes(x["g"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def blocks(all_found: Column) -> Column:
        first = F.struct(zero.alias("at"), empty.alias("out"))
        return F.transform(F.sequence(F.lit(1), F.size(all_found), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(all_found, i, BLOCK), first, step))

    def placed(parts: Column) -> Column:
        starts = F.aggregate(parts, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        move = lambda s, o: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["value"].alias("value"))
        return F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda x, o: F.transform(x["out"], lambda s: move(s, o))))

    return F.when(on, let(let(found, blocks), placed)).otherwise(empty)


def upper_tail(z: Column) -> Column:
    """Probability of a standard normal above z, to about 1 %."""
    x = F.abs(z)
    q = F.exp(-x * x / 2) * (2 / math.sqrt(2 * math.pi)) / (x + F.sqrt(x * x + 8 / math.pi))
    return F.when(z >= 0, q).otherwise(1 - q)


def battery(found: DataFrame, value: str = "value") -> DataFrame:
    """Adds encoding, n, p_random and p_natural to candidate strings.

    The encoding is inferred from the characters. p_random: three times the least of the
    p-values of chi-squared uniformity over the alphabet, of the runs about its middle, and of
    the correlation of neighbours, for a random string. p_natural: chance that natural text of
    that length is as uniform as this; it falls with length, so short strings seldom pass.
    """
    core = F.regexp_replace(F.col(value), "=+$", "")
    kind = F.when(core.rlike("^[0-9a-f]+$") | core.rlike("^[0-9A-F]+$"), "hex").when(core.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    found = found.withColumn("encoding", kind).withColumn("core", F.when(kind == "hex", F.lower(core)).otherwise(F.translate(core, "-_", "+/")))
    pick = lambda i: reduce(lambda c, e: c.when(F.col("encoding") == e, F.lit(ENCODINGS[e][i])), ENCODINGS, F.when(F.lit(False), F.lit(ENCODINGS["hex"][i])))
    found = found.withColumns({"alphabet": pick(0), "delta": pick(1), "chars": F.filter(F.split("core", ""), lambda c: c != "")})
    found = found.withColumns({"x": F.transform("chars", lambda c: F.call_function("instr", F.col("alphabet"), c).cast("double") - 1), "n": F.size("chars"), "a": F.length("alphabet")})
    n, a = F.col("n").cast("double"), F.col("a").cast("double")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    counts = F.transform(F.array_distinct("chars"), lambda c: F.pow((F.col("n") - F.length(F.replace(F.col("core"), c, F.lit("")))).cast("double"), F.lit(2.0)))
    found = found.withColumn("chi", a / n * total(counts) - n).withColumn("mean", total(F.col("x")) / n)
    pairs = F.arrays_zip(F.slice("x", 1, F.col("n") - 1).alias("u"), F.slice("x", 2, F.col("n") - 1).alias("v"))
    found = found.withColumns({
        "high": total(F.transform("x", lambda v: (v >= F.col("a") / 2).cast("double"))),
        "runs": 1 + total(F.transform(pairs, lambda p: ((p["u"] >= F.col("a") / 2) != (p["v"] >= F.col("a") / 2)).cast("double"))),
        "cov": total(F.transform(pairs, lambda p: (p["u"] - F.col("mean")) * (p["v"] - F.col("mean")))),
        "var": total(F.transform("x", lambda v: (v - F.col("mean")) * (v - F.col("mean")))),
    })
    both = 2 * F.col("high") * (n - F.col("high"))
    spread = both * (both - n) / (n * n * (n - 1))
    z_chi = (F.col("chi") - (a - 1)) / F.sqrt(2 * (a - 1))
    z_runs = F.when(spread > 0, (F.col("runs") - 1 - both / n) / F.sqrt(spread)).otherwise(F.lit(40.0))
    z_serial = F.when(F.col("var") > 0, (F.col("cov") / F.col("var") + 1 / n) * F.sqrt(n)).otherwise(F.lit(40.0))
    random = F.least(upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial)))
    natural = ((a - 1) + n * F.col("delta") - F.col("chi")) / F.sqrt(2 * (a - 1) + 4 * n * F.col("delta"))
    return found.withColumns({"p_random": F.least(3 * random, F.lit(1.0)), "p_natural": upper_tail(natural)}).drop("core", "alphabet", "delta", "chars", "x", "a", "chi", "mean", "high", "runs", "cov", "var")


def _bin(p: str) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-60))) * BINS), F.lit(60 * BINS)).cast("int")


def _step_up(binned: DataFrame, bin: str) -> DataFrame:
    """(class, cut): by Benjamini-Hochberg, p-values of a class are rejected from bin cut on; classes without one have no row."""
    hist = binned.groupBy("class", F.col(bin).alias("bin")).agg(F.count("*").alias("c"))
    down = Window.partitionBy("class").orderBy(F.desc("bin"))
    hist = hist.select("class", "bin", F.sum("c").over(down).alias("above"), F.sum("c").over(Window.partitionBy("class")).alias("m"))
    return hist.where(F.pow(F.lit(10.0), -F.col("bin") / BINS) <= FALSE_DISCOVERY * F.col("above") / F.col("m")).groupBy(F.col("class").alias(f"{bin}_class")).agg(F.min("bin").alias(f"{bin}_cut"))


def discoveries(tested: DataFrame) -> DataFrame:
    """Rows of tested that are found by control of false discoveries within their class of lengths, twice over.

    Benjamini-Hochberg rejects that a string is natural, by the uniformity of its alphabet;
    and among the strings it rejects, by uniformity, runs and serial correlation together, that
    they are random. What is not natural and not rejected as random is a discovery. P-values
    are counted in bins of a twentieth of a decade: a few thousand rows whatever the input, so
    the step-up thresholds need no global sort; the cuts, a row a class, are broadcast.
    """
    size = reduce(lambda c, i: F.when(F.col("n") >= CLASSES[i], i).otherwise(c), range(1, len(CLASSES)), F.lit(0))
    binned = tested.withColumns({"class": size, "natural": _bin("p_natural"), "random": _bin("p_random")})
    for bin in ("natural", "random"):
        binned = binned.join(F.broadcast(_step_up(binned, bin)), F.col("class") == F.col(f"{bin}_class"), "left")
    found = (F.col("natural") >= F.col("natural_cut")) & (F.col("random_cut").isNull() | (F.col("random") < F.col("random_cut")))
    return binned.where(found).drop("class", "natural", "random", "natural_class", "natural_cut", "random_class", "random_cut")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row: arrays of (start, kind, end), by start, then kind as in KINDS.

    base holds the pattern matches: assignments with a value of six characters, access keys of
    20 and lower-case hex runs of 24. spans adds strings of 20 or more encoded characters that
    pass discoveries() and overlap no match of a pattern. Whole texts in one pass; a null text counts
    as empty, and repeated rows repeat their result. An empty table gives no row; other columns,
    whatever their names, are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(F.col("t"))
    rows = docs.select("doc_id", text.alias("t"))
    named = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in ("passw", "secret", "token", "api")])
    rows = rows.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        spans(F.col("t"), ASSIGN, named, lambda g: F.length(g) >= 6, 2).alias("assign"),
        spans(F.col("t"), ACCESS, F.contains(F.col("t"), F.lit("AKIA")), lambda g: F.length(g) >= 20).alias("access"),
        spans(F.col("t"), HEX, F.col("t").rlike("[0-9a-f]{24}")).alias("hex"),
        spans(F.col("t"), CANDIDATE, F.col("t").rlike("[A-Za-z0-9+/_-]{20}")).alias("candidates"),
    )
    place = lambda k: F.transform(KINDS[k], lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    rows = rows.select("doc_id", "row", F.array_sort(F.concat(place(0), place(1), place(2))).alias("base"), "candidates")
    rows = keep(rows, "spans")
    free = rows.select("row", "base", F.explode("candidates").alias("c")).where(~F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start"))))
    tested = keep(battery(free.select("row", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.value").alias("value"))).drop("value"), "tested")
    extra = discoveries(tested).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("extra")).withColumnRenamed("row", "r")
    joined = rows.join(extra, F.col("row") == F.col("r"), "left")
    return joined.select("doc_id", "base", F.array_sort(F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", "extra"))).alias("spans"))


def listing(found: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of a scan."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listing("base"), 256).alias("base_sha256"), listing("spans").alias("spans"))
