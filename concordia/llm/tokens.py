"""Token counts per section by offset-mapped attribution.

A document is encoded once, as a whole, so counts add up to what a model would see.  The bytes
of each token give its span, and the spans are joined to the sections' intervals by binary
search.  A token that crosses a boundary is allocated by a stated rule: ``"first"``, the section
of its first byte, or ``"middle"``, the section of its middle byte (the lower one of two).

The vocabulary is a public rank file (under 2 MB); it is read on the driver and broadcast.

Defined results: a null or empty text has no tokens and no sections; sections are a text's lines,
each with its line break, unless a column gives them; given sections may overlap or leave gaps
(each counts the tokens allocated inside it) and are cut to the text; null sections are none;
bytes that aren't UTF-8 are read as U+FFFD; runs of any length are encoded whole, long ones of white
space apart from the pattern (a pattern other than the default is left to its own limits); repeated rows are counted one by one; other columns are
not used, and a result named like the id column gets an underscore after its name.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import quoted, spread

#: Fixed value: the pattern that splits text before the merges of the public byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Most bytes of a rank file that is broadcast.
MOST_VOCABULARY = 1 << 26
#: White space of so many characters in a row is taken out of the text before the pattern, whose search backs up over it, sees it.
LONG_SPACE = 1 << 14
#: The characters that the pattern counts as white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Built once in each worker from the broadcast rank file."""

    def __init__(self, file: bytes, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in file.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes[list(ranks.values())] = [len(t) for t in ranks]
        self.long = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}") if pattern == PATTERN else None

    def tokens(self, text: str) -> np.ndarray:
        """The text's tokens.

        A run of white space is one piece of the pattern, but for its last character where something
        follows, which belongs to the next piece; so a long run is merged on its own, and what is before
        and after it encoded apart, with the same result.
        """
        encode = lambda t: np.asarray(self.encoding.encode_to_numpy(t, disallowed_special=()), np.int64)
        parts, at = [], 0
        for run in self.long.finditer(text) if self.long and len(text) >= LONG_SPACE else ():
            end = run.end() - (run.end() < len(text))
            parts += [encode(text[at : run.start()]), np.asarray(self.encoding._encode_single_piece(text[run.start() : end]), np.int64)]
            at = end
        return np.concatenate([*parts, encode(text[at:])]) if parts else encode(text)

    def places(self, text: str, rule: str) -> np.ndarray:
        """The byte of each token that decides its section."""
        size = self.bytes[self.tokens(text)]
        start = np.cumsum(size) - size
        return start if rule == "first" else start + (size - 1) // 2


def _lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends[:-1]]), ends


def section_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "first"
) -> DataFrame:
    """A row per section: ``(id, section, start, end, n_tokens, doc_tokens)``; start and end are code points.

    ``sections_col`` may name an array of structs with integer ``start`` and ``end``.
    """
    if rule not in ("first", "middle"):
        raise ValueError("rule is first or middle")
    with open(vocabulary, "rb") as f:
        file = f.read(MOST_VOCABULARY + 1)
    if len(file) > MOST_VOCABULARY:
        raise ValueError("the rank file is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(file)
    given = sections_col is not None

    def count(batches):
        encoder = Encoder(shared.value, pattern)
        for b in batches:
            column, out, held = b.column(1), [], 0
            for i in range(b.num_rows):
                raw = column[i].as_buffer().to_pybytes() if column[i].is_valid else b""
                if not raw:
                    continue
                text = raw.decode("utf-8", "replace")
                data = np.frombuffer(text.encode(), np.uint8)
                points = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each code point
                if given:
                    rows = [s for s in (b.column(2)[i].as_py() or []) if s is not None]
                    at = np.array([[s["start"], s["end"]] for s in rows], np.int64).reshape(-1, 2).clip(0, len(points))
                    to_byte = np.append(points, len(data))
                    lo, hi, start, end = to_byte[at[:, 0]], to_byte[at[:, 1]], at[:, 0], at[:, 1]
                else:
                    lo, hi = _lines(data)
                    start, end = np.searchsorted(points, lo), np.searchsorted(points, hi)
                place = encoder.places(text, rule)
                n = np.maximum(np.searchsorted(place, hi) - np.searchsorted(place, lo), 0)
                out.append((i, len(place), start, end, n))
                held += len(n)
                if held >= 1 << 16:
                    yield _batch(b, out)
                    out, held = [], 0
            if out:
                yield _batch(b, out)

    id_type = docs.schema[id_col].dataType.simpleString()
    columns = [F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text")]
    if given:
        columns.append(F.transform(F.col(quoted(sections_col)), lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("sections"))
    schema = f"id {id_type}, section long, start long, end long, n_tokens long, doc_tokens long"
    found = docs.select(*columns).mapInArrow(count, schema)
    named = lambda c: c + "_" if c == id_col else c
    return found.select(F.col("id").alias(id_col), *[F.col(c).alias(named(c)) for c in found.columns[1:]])


def _batch(b: pa.RecordBatch, out: list) -> pa.RecordBatch:
    row, total, start, end, n = zip(*out, strict=True)
    owner, section = spread(np.array([len(x) for x in n]))
    ids = b.column(0).take(pa.array(np.array(row)[owner]))
    longs = [section, np.concatenate(start), np.concatenate(end), np.concatenate(n), np.array(total)[owner]]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in longs)], [b.schema.names[0], "section", "start", "end", "n_tokens", "doc_tokens"])
