"""Secret scans: fixed patterns, and windows of high Shannon entropy in candidate strings.

A candidate is a maximal run of 20 or more characters of the base64 alphabet that holds a digit and a letter. Its class
is hex (only hex digits) or mixed. A window of WINDOW characters slides over it. The state holds the count of each
character in the window; a step raises the count of the character that enters, lowers that of the one that leaves, and
changes the sum of c * log2(c) over the counts c by those two. A candidate with a window over its class's threshold
becomes a span of kind entropy. The allow list suppresses UUIDs, repeated units, digits alone, words with a short number
and documented example keys as a whole; dates and words that say example are taken out first, and what is left is judged, so
that they don't hide a secret beside them. All of it is DataFrame functions on single rows, linear in the length of the
text: there is no shuffle.

Null texts count as empty and have no spans. Repeated rows and rows without an id each get their row. An empty table
gives an empty result. Other columns are kept by scan() and redact(), but for base and found, which scan() adds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside

#: Kinds in the order of ties, with the least length of what a match must hold.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character: windows of 20 have 4.32 at most, hex windows 4.0.
THRESHOLD = {"hex": 3.0, "mixed": 3.6}
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^(.{1,8})\1+$",
    r"^[A-Za-z_/=+-]*\d{1,4}$",
    r"^[0-9+/_=-]*$",
    r"^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY=*$",
)
#: Parts that are no secrets; the rest of their candidate is judged without them.
HARMLESS = r"(?i)(?:example|sample|placeholder|xxxx)[A-Za-z]*|(?<![0-9])\d{4}-\d{2}-\d{2}(?:T\d{2}(?:-?\d{2}){0,2}Z?)?(?![0-9])"
#: Matches in a block of a scan: positions are added up by block, then within blocks.
BLOCK = 256
#: The first and last character of CANDIDATE's alphabet, by code.
CODES = (43, 122)
#: c * log2(c) for counts c, in units small enough that whole numbers can be added without drift.
UNIT = 1 << 40
TERMS = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPAN = "struct<start:int,rank:int,kind:string,end:int,text:string>"


def _matches(pattern: str, kind: str, rank: int, keep: str) -> str:
    """SQL of the array of spans of pattern in __t: lengths of matches and of what lies between, added up by block of
    matches, then within each. keep: a test of m, the match."""
    q = _quoted(pattern)
    part = f"sequence(b * {BLOCK}, least((b + 1) * {BLOCK}, size(z.m)) - 1)"
    ahead = "z.g[i] + char_length(z.m[i])"
    return f"""if(__t rlike {q},
      transform(array(named_struct('m', regexp_extract_all(__t, {q}, 0), 'g', transform(split(__t, {q}, -1), x -> char_length(x)))), z ->
        transform(array(sequence(0, cast((size(z.m) - 1) div {BLOCK} as int))), bs ->
          transform(array(aggregate(transform(bs, b -> aggregate({part}, 0, (n, i) -> n + {ahead})), array(0), (o, n) -> concat(o, array(o[size(o) - 1] + n)))), o ->
            flatten(transform(bs, b -> aggregate({part}, named_struct('at', o[b], 'out', cast(array() as array<{SPAN}>)),
              (s, i) -> named_struct('at', s.at + {ahead}, 'out', transform(array(z.m[i]), m ->
                if({keep}, concat(s.out, array(named_struct('start', s.at + z.g[i], 'rank', {rank}, 'kind', '{kind}', 'end', s.at + z.g[i] + char_length(m), 'text', m))), s.out))[0]),
              s -> s.out))))[0])[0])[0],
      cast(array() as array<{SPAN}>))"""


def _entropy(m: str) -> str:
    """SQL of the greatest entropy of a window of m. The state: counts n by character, their sum of c * log2(c), its least so far."""
    first, last = CODES
    terms = f"array({', '.join(f'{x}L' for x in TERMS)})"
    change = f"if(z.old = z.new, 0L, {terms}[a.n[z.new] + 1] - {terms}[a.n[z.new]] - if(z.old < 0, 0L, {terms}[a.n[z.old]] - {terms}[a.n[z.old] - 1]))"
    counts = "if(z.old = z.new, a.n, transform(a.n, (c, k) -> c + if(k = z.new, 1, 0) - if(k = z.old, 1, 0)))"
    return f"""transform(array(transform(filter(split({m}, ''), c -> c <> ''), c -> ascii(c) - {first})), cs ->
      aggregate(sequence(0, size(cs) - 1), named_struct('n', array_repeat(0, {last - first + 1}), 's', 0L, 'least', {1 << 60}L),
        (a, i) -> transform(array(named_struct('new', cs[i], 'old', if(i >= {WINDOW}, cs[greatest(i - {WINDOW}, 0)], -1))), z ->
          transform(array(a.s + {change}), s -> named_struct('n', {counts}, 's', s, 'least', if(i >= {WINDOW - 1}, least(a.least, s), a.least)))[0])[0],
        a -> (log2({WINDOW}D) - a.least / {float(UNIT)}D / {WINDOW})))[0]"""


def _suspect() -> str:
    """SQL of whether candidate m has a window over its class's threshold: r is what is left of it."""
    allowed = " or ".join(f"m rlike {_quoted(p)}" for p in ALLOWED)
    return f"""if({allowed}, false, transform(array(regexp_replace(m, {_quoted(HARMLESS)}, '')), r ->
      if(char_length(r) < {WINDOW} or not (r rlike '[0-9]' and r rlike '[A-Za-z]') or r rlike {_quoted(ALLOWED[2])}, false,
        {_entropy('r')} > if(r rlike '^[0-9A-Fa-f]+$', {THRESHOLD['hex']}D, {THRESHOLD['mixed']}D)))[0])"""


def spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, rank, kind, end, text) by kind; they read a column named __t, which must hold text."""
    return {
        "assign": F.expr(_matches(ASSIGN, "assign", 0, f"char_length(regexp_extract(m, {_quoted(ASSIGN)}, 1)) >= 6")),
        "access": F.expr(_matches(ACCESS, "access", 1, "true")),
        "hex": F.expr(_matches(HEX, "hex", 2, "true")),
        "entropy": F.expr(_matches(CANDIDATE, "entropy", 3, _suspect())),
    }


def scan(docs: DataFrame) -> DataFrame:
    """docs with base (the spans of the patterns) and found (all spans), each by start, then by kind."""
    out = docs.drop("base", "found").withColumn("__t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    kinds = spans(F.col("__t"))
    out = out.withColumns({f"__{k}": v for k, v in kinds.items()})
    base = F.concat("__assign", "__access", "__hex")
    return out.withColumns({"base": F.array_sort(base), "found": F.array_sort(F.concat(base, F.col("__entropy")))}).drop("__t", *(f"__{k}" for k in kinds))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by mark; overlapping spans are replaced together. Rows without spans, null
    texts among them, stay as they are."""
    rest, back = aside(docs, "base", "found", "__t", "__assign", "__access", "__hex", "__entropy")
    found = scan(rest)
    cut = f"""if(size(found) = 0, text, transform(array(aggregate(found, named_struct('at', 0, 'out', cast(array() as array<string>)),
      (s, x) -> if(x.start >= s.at, named_struct('at', x.end, 'out', concat(s.out, array(substring(text, s.at + 1, x.start - s.at), {_quoted(mark)}))),
                   named_struct('at', greatest(s.at, x.end), 'out', s.out)))), z -> concat(array_join(z.out, ''), substring(text, z.at + 1)))[0])"""
    return found.withColumn("text", F.expr(cut)).select(*rest.columns).withColumnsRenamed(back)


def _joined(name: str) -> Column:
    return F.expr(f"array_join(transform({name}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, the counts by kind, the digest of the base spans, all spans."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) as bigint)")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"))
