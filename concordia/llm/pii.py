"""Personal data in text: patterns propose, checksums confirm, context words weigh; DataFrame functions only.

Base kinds, leftmost and non-overlapping within a kind: ``email``, ``ip`` (parts at most 255),
``card`` (16 to 19 digits that pass Luhn), ``phone`` (+, 8 to 15 digits).  They are always
reported.  Further kinds are proposed by patterns and reported if their score, a prior plus
what their checksum and the words around them give, reaches ``LEAST_SCORE`` and they overlap
no base span: ``iban`` (mod 97), ``local_phone``, ``national_id`` and ``secret``.

Positions are code points, the end exclusive.  A text is split at a pattern's matches; the
lengths of the pieces and the matches give the positions by sums in two levels, so that a text
with very many matches costs little more than its length.

The patterns differ from the plain ones only in possessive repeats and in starting at the first
character of a run; both give the same matches (every shorter start fails or succeeds alike), but
never rescan a long run.

Defined results: a null or empty text has no spans; repeated rows are reported one by one; other
columns are carried along, and those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import packed, unpacked, with_running_sums

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "national_id", "secret")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<=[=:\x20\x22'])[A-Za-z0-9+/_-]{16,}+(?![A-Za-z0-9])",
}
#: A text without this character cannot hold the kind.
_NEEDS = {"email": "@", "phone": "+"}
#: What a candidate starts with, and what context or a checksum adds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.4, "phone": 0.6, "iban": 0.3, "local_phone": 0.3, "national_id": 0.3, "secret": 0.2}
CONTEXT = {
    "email": r"e-?mail|contact|write|address", "ip": r"\bip\b|host|server|addr", "card": r"card|credit|visa|master|payment|account", "phone": r"phone|tel|call|fax|mobile",
    "iban": r"iban|bank|account|transfer|swift", "local_phone": r"phone|tel|call|fax|mobile", "national_id": r"ssn|social|national|identity", "secret": r"(?:password|passwd|token|secret|api[_-]?key)\s*[=:]",
}
CHECKSUM_ADDS, CONTEXT_ADDS, LEAST_SCORE, AROUND = 0.5, 0.4, 0.6, 32


def _with_starts(rows: DataFrame, kind: str) -> DataFrame:
    """``_s_<kind>``: where each match begins, from ``_m_<kind>`` (matches) and ``_p_<kind>`` (lengths of the pieces around them)."""
    m, p, g = (f"_{x}_{kind}" for x in "mpg")
    gaps = F.transform(p, lambda x, i: x + F.when(i == 0, 0).otherwise(F.length(F.get(m, i - 1))))  # match i: all pieces to i, all matches before
    rows = rows.withColumn(g, F.when(F.size(m) > 0, F.slice(gaps, F.lit(1), F.size(m))).otherwise(F.array().cast("array<int>")))
    return with_running_sums(rows, g, f"_s_{kind}").drop(p, g)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(iban: Column) -> Column:
    """Remainder of an IBAN read as a number, its first four characters last and letters as 10 to 35."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    code = lambda c: F.ascii(c)
    step = lambda acc, c: F.when(code(c) >= 65, (acc * 100 + code(c) - 55) % 97).otherwise((acc * 10 + code(c) - 48) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _confirmed(kind: str, text: Column) -> Column:
    """Whether a match is what its kind asks for; for kinds with a checksum, whether that passes."""
    if kind == "ip":
        small = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return text.rlike(rf"^{small}\.{small}\.{small}\.{small}$")
    if kind == "card":
        return F.length(_digits(text)).between(16, 19) & F.call_function("luhn_check", _digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    if kind == "iban":
        return _mod97(text) == 1
    return F.lit(True)


def _found(kind: str, text: Column, matches: Column, starts: Column) -> Column:
    """The confirmed matches as spans with their scores."""
    spans = F.zip_with(matches, starts, lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("found")))
    spans = F.filter(spans, lambda x: _confirmed(kind, x["found"]))

    def scored(x: Column) -> Column:
        first = F.greatest(x["start"] - AROUND, F.lit(0))
        near = F.lower(F.substr(text, first + 1, x["end"] - first + AROUND))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), CONTEXT_ADDS).otherwise(0.0) + (CHECKSUM_ADDS if kind in ("card", "iban") else 0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), F.least(score, F.lit(1.0)).alias("score"), x["found"].alias("found"))

    return F.transform(spans, scored)


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double,found:string>>"


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of (kind, start, end, score, found) by kind as listed, then start."""
    own = {"_text": text_col}
    rows = packed(docs, **own).withColumn("_t", F.coalesce(F.col("_text").cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        there = F.contains("_t", F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
        rows = rows.withColumn(f"_m_{kind}", F.when(there, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, pattern in PATTERNS.items():
        some = F.size(f"_m_{kind}") > 0
        rows = rows.withColumn(f"_p_{kind}", F.when(some, F.transform(F.split("_t", pattern, -1), lambda p: F.length(p))).otherwise(F.array().cast("array<int>")))
        rows = _with_starts(rows, kind)
    kinds = {k: F.when(F.size(f"_m_{k}") > 0, _found(k, F.col("_t"), F.col(f"_m_{k}"), F.col(f"_s_{k}"))).otherwise(F.array()).cast(_SPANS) for k in PATTERNS}
    rows = rows.withColumn("base", F.concat(*[kinds[k] for k in BASE])).withColumn("_more", F.concat(*[kinds[k] for k in ADDED]))
    clear = lambda a: (a["score"] >= LEAST_SCORE) & ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))
    rows = rows.withColumn("added", F.filter("_more", clear))
    return unpacked(rows, docs, own, "base", "added")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span replaced by ``[KIND]``; of overlapping spans the first, then the longest, counts."""
    own = {"_text": text_col}
    rows = find(packed(docs, **own), "_text")
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.coalesce(F.col("_text"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(kept.alias("out"), (-s["end"]).alias("at"))).otherwise(acc)

    new = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
    rows = rows.withColumn("_text", F.when(F.col("_text").isNotNull(), new)).drop("base", "added")
    return unpacked(rows, docs, own)
