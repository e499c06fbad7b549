"""Quality rules: a table of thresholds, compiled into Spark columns over counts of a text.

The counts are words, symbols, stop words and lines; a rule bounds the ratio of two of them in
hundredths, so that it is decided in whole numbers.  Everything is a projection of built-in
functions: no user function, no shuffle, and a text's counts need no other row.

A word is a run of characters other than space and U+0009 to U+000D; lines end at ``\\n``, and
lines without a word count for nothing.  A window is eight words in a row; windows are told apart
by 128-bit hashes, made only for texts in which a 64-bit hash comes twice.

Defined results: a null text has no words; a text with fewer words than a window repeats none;
rows are judged one by one, so ties and repeated rows are judged alike; an empty table gives no
rows; columns named like a count are kept by ``judged`` under ``_row`` only, and by ``keep`` as
they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import quoted

#: Words in a window of the repetition count.
WINDOW = 8
#: The symbols counted by the base rules.
SYMBOLS = "#*$%&|<>"
#: Common function words by language; their share tells prose from lists, names and noise.
STOP_WORDS = {
    "en": "a all an and are as at be been but by for from had has have he her his i if in is it its my no not of on or our she so that the their there they this to was we were what when which who will with you".split(),
    "de": "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sein sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur".split(),
    "es": "a al como con de del el ella en era es esta este esto ha la las le lo los más me mi no nos o para pero por que se si sin sobre son su sus también un una y ya yo".split(),
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais mes ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur tu un une vous y".split(),
}


@dataclass(frozen=True)
class Rule:
    """A text fails where 100 x ``of`` is below ``least`` x ``per``, or above ``most`` x ``per``; without ``per``, ``of`` itself is bounded.

    ``base`` marks the rules that fail a text whatever the others say.
    """

    name: str
    of: str
    per: str | None = None
    least: int | None = None
    most: int | None = None
    base: bool = False

    def fails(self) -> Column:
        value, unit = (F.col(self.of) * 100, F.col(self.per)) if self.per else (F.col(self.of), F.lit(1))
        tests = ([value < unit * self.least] if self.least is not None else []) + ([value > unit * self.most] if self.most is not None else [])
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]


#: The table. Ratios in hundredths.
TABLE = (
    Rule("few words", "n_words", least=20, base=True),
    Rule("repeated windows", "n_repeat_words", "n_words", most=30, base=True),
    Rule("word length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("shouting", "n_marks", "n_words", most=50),
    Rule("letters", "n_letter_words", "n_words", least=70),
    Rule("stop words", "n_stop_words", "n_words", least=3),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullets", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", most=30),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_letter_words", "n_stop_words", "n_repeat_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")
_BLANK = r"[\x20\x09-\x0D]"


def _number(array: Column) -> Column:
    return F.size(array).cast("long")


def _characters(text: Column, of: str) -> Column:
    """How many of its characters are among ``of``."""
    return (F.length(text) - F.length(F.translate(text, of, ""))).cast("long")


def counted(docs: DataFrame, text_col: str = "text", stop_words: dict[str, list[str]] | None = None) -> DataFrame:
    """``COUNTS`` of each row's text, all columns of the row in the struct ``_row``."""
    common = sorted({w for ws in (stop_words or STOP_WORDS).values() for w in ws})
    rows = docs.select(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("_text"), F.struct("*").alias("_row"))
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", _BLANK + "+"), ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    rows = _with_repeats(rows)
    inner = lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?"))
    starts = lambda x: F.ltrim(x, F.lit(" \t"))
    counts = {
        "n_words": _number(F.col("_words")),
        "word_chars": (F.length("_text") - _characters(F.col("_text"), " \t\n\x0b\x0c\r")).cast("long"),
        "n_symbols": _characters(F.col("_text"), SYMBOLS),
        "n_marks": _characters(F.col("_text"), "!"),
        "n_letter_words": _number(F.filter("_words", lambda w: w.rlike(r"\p{L}"))),
        "n_stop_words": _number(F.filter("_words", lambda w: inner(w).isin(common))),
        "n_repeat_words": F.col("n_repeat_words"),
        "n_lines": _number(F.col("_lines")),
        "n_dup_lines": _number(F.col("_lines")) - _number(F.array_distinct("_lines")),
        "n_bullet_lines": _number(F.filter("_lines", lambda x: F.substring(starts(x), 1, 1).isin("-", "*", "•"))),
        "n_ellipsis_lines": _number(F.filter("_lines", lambda x: F.rtrim(x, F.lit(" \t\r")).endswith("...") | F.rtrim(x, F.lit(" \t\r")).endswith("…"))),
    }
    return rows.select("_row", *[_settled(counts[c]).alias(c) for c in COUNTS])


def _settled(c: Column) -> Column:
    """The same value, as an expression that a filter on it is not pushed below of.

    Such a filter would take in whole arrays' expressions in the place of their columns, inside functions
    of each element: the square of a text's length.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def _with_repeats(rows: DataFrame) -> DataFrame:
    """``n_repeat_words``: words inside a window that the text holds twice or more.

    Windows' hashes are sorted with their places; those next to an equal one are repeated, and
    each adds the words that the repeated window before it doesn't cover.
    """
    last = F.size("_words") - WINDOW
    none = F.array().cast("array<bigint>")
    window = lambda i: F.slice("_words", i + 1, WINDOW)
    rows = rows.withColumn("_hash", F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(window(i)))).otherwise(none))
    some = F.size(F.array_distinct("_hash")) < F.size("_hash")
    place = lambda h, i: F.struct(h.alias("h"), F.xxhash64(F.lit(1), window(i)).alias("g"), i.alias("i"))
    rows = rows.withColumn("_sorted", F.when(some, F.sort_array(F.transform("_hash", place))))
    like = lambda x, j: F.coalesce((F.get("_sorted", j)["h"] == x["h"]) & (F.get("_sorted", j)["g"] == x["g"]), F.lit(False))
    rows = rows.withColumn("_again", F.sort_array(F.transform(F.filter("_sorted", lambda x, j: like(x, j - 1) | like(x, j + 1)), lambda x: x["i"])))
    gaps = F.zip_with(F.slice("_again", F.lit(1), F.size("_again") - 1), F.slice("_again", F.lit(2), F.size("_again") - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    words = F.when(F.coalesce(F.size("_again"), F.lit(0)) > 0, F.aggregate(gaps, F.lit(WINDOW), lambda n, x: n + x)).otherwise(F.lit(0))
    return rows.withColumn("n_repeat_words", words.cast("long"))


def judged(docs: DataFrame, table: tuple[Rule, ...] = TABLE, text_col: str = "text", stop_words: dict[str, list[str]] | None = None) -> DataFrame:
    """Each row's counts, ``failed`` (names of the rules it breaks), ``base_failed`` and ``kept``; its own columns in ``_row``."""
    rows = counted(docs, text_col, stop_words)
    failed = F.array_compact(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in table])) if table else F.array().cast("array<string>")
    base = [r.name for r in table if r.base]
    of_base = F.arrays_overlap("failed", F.array(*[F.lit(n) for n in base])) if base else F.lit(False)
    return rows.select("_row", *COUNTS, failed.alias("failed")).withColumns({"base_failed": of_base, "kept": F.size("failed") == 0})


def keep(docs: DataFrame, table: tuple[Rule, ...] = TABLE, text_col: str = "text", stop_words: dict[str, list[str]] | None = None) -> DataFrame:
    """The rows that break no rule, with their own columns only."""
    return judged(docs, table, text_col, stop_words).where("kept").select("_row.*")
