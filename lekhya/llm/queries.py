"""Registered queries of the operators for training text, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.llm import crc_resampling, decontaminate, line_dedup, lm_score, matroska, merkle, mixing, quality, repetition, secrets, simhash_dedup, url_filter, warc
from lekhya.llm.common import keep

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best window for each benchmark item at similarity 0.8 or more."""
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every whole document."""
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is that of the label with its id: good if of quality 1 and not toxic."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return url_filter.judge(_table(spark, sf_dir, "pages"), labels, RULES)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importance sample of all documents."""
    return quality.sampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the secrets of every document."""
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op8_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives that it was written to."""
    written = keep(warc.archives(_table(spark, sf_dir, "pages")), "archives")
    return warc.records(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the file that it was stored in."""
    return matroska.digests(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the lines taken out of each document, as a comma-joined list."""
    out = line_dedup.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document."""
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's texts, and the rank of those drawn."""
    out = crc_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, with the rules that it breaks."""
    out = repetition.judge(_table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*base, F.array_join("broken", ",").alias("broken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_url_filter": op3_url_filter,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality_resampling": op5_quality_resampling,
    "op6_source_mixing": op6_source_mixing,
    "op7_secret_scan": op7_secret_scan,
    "op8_warc_dictionary": op8_warc_dictionary,
    "op9_matroska_media": op9_matroska_media,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_target_resampling": op12_target_resampling,
    "op13_repetition_rules": op13_repetition_rules,
}

_OP3 = r"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
own as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts),
good as (select doc_id, min(case when quality = 1 and toxic = 0 then 1 else 0 end) as good from labels group by doc_id),
labels_of as (select host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as parts, good from own left join good on page_id = doc_id),
hosts as (select host, count(good) as n, coalesce(sum(good), 0) as k,
  array_to_string(list_slice(parts, case when array_to_string(list_slice(parts, -2, -1), '.') in (TWO_LABEL) then -3 else -2 end, -1), '.') as domain from labels_of group by host, parts),
domains as (select domain, regexp_replace(domain, '^[^.]*\.', '') as suffix, sum(n) as n, sum(k) as k from hosts group by domain),
tops as (select suffix, sum(n) as n, sum(k) as k from domains group by suffix),
total as (select (sum(k) + 1.0) / (sum(n) + 2.0) as m from tops),
levels as (select 1 as level, n, k from tops union all select 2, n, k from domains union all select 3, n, k from hosts),
moments as (select level, count(*) as g, sum(n) as n, sum(n * n) as nn, sum(n * (k / n - m) * (k / n - m)) as w, any_value(m) * (1 - any_value(m)) as v from levels, total where n > 0 group by level),
rho as (select level, g, (w - v * (g - 1)) / (v * (n - nn / n - (g - 1))) as r from moments),
strength as (select level, case when g < 2 or r is null or r <= 0 then 1000.0 else least(greatest((1 - r) / r, 8.0), 1000.0) end as s from rho),
s as (select max(s) filter (level = 1) as s1, max(s) filter (level = 2) as s2, max(s) filter (level = 3) as s3, any_value(m) as m from strength, total),
t as (select suffix, (m * s1 + k) / (s1 + n) as mt from tops, s),
d as (select domain, (mt * s2 + n0.k) / (s2 + n0.n) as md from domains n0 join t using (suffix), s),
h as (select host, (md * s3 + k) / (s3 + n) as mh, s3 + n as size from hosts join d using (domain), s),
b as (select host, mh - 1.645 * sqrt(mh * (1 - mh) / (size + 1)) as bound from h),
rules(rule, name, start, what) as (values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
fit as (select page_id as pid, host as ph, path as pp, max_by(rule, length(rule)) as rule, max_by(what, length(rule)) as what
  from (select distinct page_id, host, path from own) join rules on (host = name or ends_with(host, '.' || name)) and starts_with(path, start) group by all)
select page_id, own.host, path, rule, coalesce(what, case when bound >= 0.5 then 'allow' else 'block' end) as verdict
from own join b using (host) left join fit on pid is not distinct from page_id and ph = own.host and pp = path
"""

_OP3 = _OP3.replace("TWO_LABEL", ", ".join(f"'{x}'" for x in url_filter.TWO_LABEL))

#: Rounds of the sharing: each stops at least one source, unless none is above; 24 exceed the 20 sources of the tables.
_OP6 = r"""
with recursive own as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(coalesce(doc_id::varchar, '')) as key from documents),
totals as (select source, sum(size)::bigint as n, ([3.0, 1.0, 2.0])[1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w from own group by source),
share(round, source, n, w, stopped) as (
  select 0, source, n, w, false from totals
  union all
  select round + 1, source, n, w, stopped or (1.5 * sum(n) over () - sum(case when stopped then 2.0 * n else 0 end) over ()) * w / nullif(sum(case when stopped then 0 else w end) over (), 0) > 2.0 * n
  from share where round < 24),
want as (select source as s, n as source_size, case when stopped then 2.0 * n else (1.5 * sum(n) over () - sum(case when stopped then 2.0 * n else 0 end) over ()) * w / sum(case when stopped then 0 else w end) over () end as target from share where round = 24),
placed as (select *, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from own)
select doc_id, size::bigint as size, source_size, target::double as target,
  ((case when source_size > 0 then floor(target / source_size) else 0 end) * size
   + least(greatest(round(target - (case when source_size > 0 then floor(target / source_size) else 0 end) * source_size) - before, 0), size))::bigint as taken
from placed join want on source is not distinct from s
"""

_OP8 = r"""
with own as (select page_id, coalesce(html, '') as html from pages),
sums as (select page_id, octet_length(encode(html)) as n, sha1(html) as sha, min(page_id) over (partition by sha1(html)) as first from own),
bits as (select *, array_to_string(list_transform(range(0, 40), lambda i: lpad(bin(instr('0123456789abcdef', substr(sha, i + 1, 1)) - 1), 4, '0')), '') as b from sums)
select page_id, n::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * substr(b, 5 * j + 1, 1)::int + 8 * substr(b, 5 * j + 2, 1)::int + 4 * substr(b, 5 * j + 3, 1)::int + 2 * substr(b, 5 * j + 4, 1)::int + substr(b, 5 * j + 5, 1)::int)::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from bits
"""

#: CRC-32 of a decimal number: a fold over its digits, eight shifts each, with the reversed polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all({x}, '.'), lambda c: ascii(c)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384::bigint))), 4294967295::bigint)"


def _climb(name: str, heights: int) -> str:
    """Steps of a tree with up to 16 ** heights leaves, from {name}0(tree, pos, n, digest): {name}k has the nodes of height k, {name}p the sides of each leaf on its way up."""
    cell = lambda k: f"select tree, pos, n, digest, coalesce(string_agg(digest, '') over (run rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(digest, '') over (run rows between 1 following and unbounded following), '') as r from {name}{k} where n > 1 window run as (partition by tree, pos // 16 order by pos)"
    steps = [f"{name}{k + 1} as (select tree, pos // 16 as pos, any_value((n + 15) // 16) as n, sha256(string_agg(digest, '' order by pos)) as digest from {name}{k} where n > 1 group by tree, pos // 16)" for k in range(heights)]
    steps += [f"{name}s{k} as ({cell(k)})" for k in range(heights)]
    sides = ", ".join(f"s{k}.l as l{k}, s{k}.r as r{k}" for k in range(heights))
    joins = " ".join(f"left join {name}s{k} s{k} on s{k}.tree = o.tree and s{k}.pos = o.pos // {16**k}" for k in range(heights))
    steps.append(f"{name}root as ({' union all '.join(f'select tree, digest from {name}{k} where n = 1' for k in range(heights + 1))})")
    steps.append(f"{name}p as (select o.tree, o.pos, {sides} from {name}0 o {joins})")
    return ",\n".join(steps)


def _op11(heights: int = 6, top: int = 3) -> str:
    """Up to 16 ** heights leaves a source and 16 ** top sources."""
    part = lambda x: f"coalesce(octet_length(encode({x}::varchar))::varchar || ':' || {x}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ways = [("a", k) for k in range(heights)] + [("b", k) for k in range(top)]
    folds, x = [], "start"
    for i, (t, k) in enumerate(ways):
        folds.append(f"f{i} as (select *, case when {t}l{k} is null then {x} else sha256({t}l{k} || {x} || {t}r{k}) end as x{i} from {f'f{i - 1}' if i else 'way'})")
        x = f"x{i}"
    siblings = " || ".join(f"coalesce({t}l{k} || {t}r{k}, '')" for t, k in ways)
    names = lambda t, n: ", ".join(f"{t}p.{c}{k} as {t}{c}{k}" for k in range(n) for c in "lr")
    return f"""
with own as (select doc_id, coalesce('=' || source, '-') as tree, {leaf("text")} as leaf, case when {_CRC.format(x="doc_id::varchar")} % 5 = 0 then {leaf(low)} end as other from documents),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from own),
a0 as (select tree, pos, n, leaf as digest from placed),
{_climb("a", heights)},
b0 as (select '' as tree, row_number() over (order by encode(tree)) - 1 as pos, count(*) over () as n, digest, tree as of from aroot),
{_climb("b", top)},
way as (select doc_id, leaf, coalesce(other, leaf) as start, b0.digest as subroot, broot.digest as root, {names("a", heights)}, {names("b", top)}
  from placed join ap using (tree, pos) join b0 on b0.of = placed.tree join bp on bp.pos = b0.pos cross join broot),
{", ".join(folds)}
select doc_id, leaf, subroot, root, sha256({siblings}) as proof_sha256, {x} as folded_root, {x} = root as verified from f{len(ways) - 1}
"""


_OP12 = r"""
with recursive crc_table as (select list(v order by i) as tab from (select i, list_reduce(list_prepend(i, range(0, 8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384::bigint)) as v from range(0, 256) t(i))),
texts as (select 'd' as kind, row_number() over () as nth, doc_id, text from documents union all select 'b', row_number() over (), null, text from benchmark),
split as (select kind, nth, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
runs as (select kind, nth, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f from split),
counted as (select kind, nth, f, count(*) as n from runs group by all),
hashed as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295::bigint) % 10000 as bucket
  from (select distinct f from counted), crc_table),
sums as (select bucket, coalesce(sum(n) filter (kind = 'd'), 0)::double as s, coalesce(sum(n) filter (kind = 'b'), 0)::double as t from counted join hashed using (f) group by bucket),
total as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from sums),
gain as (select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from sums, total),
weights as (select nth, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from counted join hashed using (f) join gain using (bucket) where kind = 'd' group by nth),
scored as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from split left join weights using (nth) where kind = 'd'),
placed as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, n_features) as place, count(*) over (partition by n_words >= 20) as total from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * total // 100 then place end as rank from placed
"""

def _op13(limits: repetition.Limits) -> str:
    """Every measure and rule anew: n-grams as joined words, counted by text, and the words that they cover."""
    top, dup = dict(limits.top), dict(limits.duplicated)
    steps = []
    for n in sorted({repetition.WINDOW, *top, *dup}):
        steps.append(f"g{n} as (select nth, i, array_to_string(w[i:i + {n - 1}], ' ') as g from (select nth, w, unnest(range(1, len(w) - {n - 2})) as i from ws))")
        steps.append(f"c{n} as (select nth, i, g, count(*) over (partition by nth, g) as c from g{n})")
        steps.append(f"p{n} as (select distinct nth, i + k as pos from c{n}, range(0, {n}) t(k) where c > 1)")
        steps.append(f"d{n} as (select p{n}.nth, count(*) as n, sum(length(word)) as chars from p{n} join words on words.nth = p{n}.nth and words.i = pos group by p{n}.nth)")
        steps.append(f"t{n} as (select nth, max(c * length(replace(g, ' ', ''))) as chars from c{n} where c > 1 group by nth)")
    joins = " ".join(f"left join d{n} on d{n}.nth = a.nth left join t{n} on t{n}.nth = a.nth" for n in sorted({repetition.WINDOW, *top, *dup}))
    rules = [("symbols", f"n_symbols > {limits.symbols_per_word}::double * greatest(n_words, 1)"), ("duplicate_lines", f"n_dup_lines > {limits.duplicate_lines}::double * greatest(n_lines, 1)"), ("duplicate_line_chars", f"dup_line_chars > {limits.duplicate_line_chars}::double * greatest(word_chars, 1)")]
    rules += [(f"top_{n}gram", f"coalesce(t{n}.chars, 0) > {most}::double * greatest(word_chars, 1)") for n, most in limits.top] + [(f"dup_{n}gram", f"coalesce(d{n}.chars, 0) > {most}::double * greatest(word_chars, 1)") for n, most in limits.duplicated]
    broken = ", ".join(f"case when {on} then '{name}' end" for name, on in rules)
    space = r"\x20\x09-\x0D"
    return rf"""
with texts as (select row_number() over () as nth, doc_id, coalesce(text, '') as text from documents),
ws as (select nth, regexp_extract_all(text, '[^{space}]+') as w from texts),
words as (select nth, unnest(w) as word, generate_subscripts(w, 1) as i from ws),
sizes as (select nth, count(*) as n_words, sum(length(word)) as word_chars from words group by nth),
rows_ as (select nth, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from texts),
lines as (select nth, line, row_number() over (partition by nth, line order by k) > 1 as again from rows_ where regexp_matches(line, '[^{space}]')),
per_line as (select nth, count(*) as n_lines, count(*) filter (again) as n_dup_lines, coalesce(sum(length(regexp_replace(line, '[{space}]', '', 'g'))) filter (again), 0) as dup_line_chars from lines group by nth),
a as (select texts.nth, doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_lines, 0) as n_lines,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(dup_line_chars, 0) as dup_line_chars from texts left join sizes using (nth) left join per_line using (nth)),
{", ".join(steps)},
told as (select doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(d{repetition.WINDOW}.n, 0) as n_repeat_words, array_to_string(list_filter([{broken}], lambda x: x is not null), ',') as broken from a {joins})
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < {repetition.LEAST_WORDS} or 100 * n_repeat_words > {repetition.MOST_REPEATED_PCT} * n_words as base_failed,
  not (n_words < {repetition.LEAST_WORDS} or 100 * n_repeat_words > {repetition.MOST_REPEATED_PCT} * n_words) and broken = '' as kept, broken from told
"""


ORACLES: dict[str, str] = {"op3_url_filter": _OP3, "op6_source_mixing": _OP6, "op8_warc_dictionary": _OP8, "op11_merkle_manifest": _op11(), "op12_target_resampling": _OP12, "op13_repetition_rules": _op13(repetition.Limits())}
