"""Fill-in-the-middle: a text cut at two seeded places, its middle moved to the end.

Texts are cut between units: a run of ASCII letters, or any other single code point.  While a
text's units are counted, piece by piece, byte and code-point offsets are noted every ``EVERY``
units; a cut is found by binary search in these checkpoints and a short rescan from the one
before it.  So a text costs one pass, and memory for a piece and the checkpoints only.

Python workers get a text and give back its number of units and two offsets; the output is put
together from the text on the JVM.

Defined results: a null text is empty; empty texts, and texts that hold a mark, stay plain;
repeated rows are cut alike, since a cut depends on id, text and seed alone; a null id counts as
an empty one; an empty table gives no rows; columns named like a result are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import PIECE, packed, texts, unpacked

#: Units between two checkpoints.
EVERY = 1024
#: Marks before the prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _starts(data: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a unit, and which begin a code point."""
    letter, point = _LETTER[data], (data & 0xC0) != 0x80
    before = np.empty(len(data), bool)
    before[:1] = after_letter
    before[1:] = letter[:-1]
    return point & ~(letter & before), point


class Checkpoints:
    """Units of one text, and where every ``every``-th begins."""

    def __init__(self, data: np.ndarray, every: int = EVERY) -> None:
        self.data, self.n, self.points = data, 0, 0
        units, at_byte, at_point, letter = [], [], [], False
        for lo in range(0, len(data), PIECE):
            part = data[lo : lo + PIECE]
            start, point = _starts(part, letter)
            place = np.flatnonzero(start)
            chosen = place[(-self.n) % every :: every]
            units.append(self.n + (-self.n) % every + every * np.arange(len(chosen)))
            at_byte.append(lo + chosen)
            at_point.append(self.points + np.cumsum(point)[chosen] - 1)
            self.n, self.points, letter = self.n + len(place), self.points + int(point.sum()), bool(_LETTER[part[-1]])
        self.units, self.at_byte, self.at_point = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (units, at_byte, at_point))

    def point(self, unit: int) -> int:
        """Code points before the unit; the whole text's for the place after the last."""
        if unit >= self.n:
            return self.points
        k = int(np.searchsorted(self.units, unit, side="right")) - 1
        lo = int(self.at_byte[k])
        hi = int(self.at_byte[k + 1]) if k + 1 < len(self.units) else len(self.data)
        start, point = _starts(self.data[lo:hi], False)  # a checkpoint begins a unit
        byte = int(np.flatnonzero(start)[unit - int(self.units[k])])
        return int(self.at_point[k]) + int(point[:byte].sum())


def _cuts(every: int):
    kind = pa.struct([("n", pa.int64()), ("lower", pa.int64()), ("upper", pa.int64())])

    @F.arrow_udf("n long, lower long, upper long")
    def cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        out = np.zeros((3, len(text)), np.int64)
        a, b = (x.to_numpy(zero_copy_only=False) for x in (one, two))
        for lo, hi, data, offsets in texts(text):
            for i in range(lo, hi):
                index = Checkpoints(data[offsets[i - lo] : offsets[i - lo + 1]], every)
                x, y = int(a[i]) % (index.n + 1), int(b[i]) % (index.n + 1)
                out[:, i] = index.n, index.point(min(x, y)), index.point(max(x, y))
        return pa.StructArray.from_arrays([pa.array(x) for x in out], fields=list(kind))

    return cuts


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", rate: int = 90, spm_rate: int = 20, every: int = EVERY) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    Of 100 texts about ``rate`` are cut, and of 100 cut ones about ``spm_rate`` have the suffix first.
    """
    own = {"id": id_col, "t": text_col}
    rows = packed(docs, **own)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumns({"_text": F.coalesce(F.col("t").cast("string"), F.lit("")), "_digest": digest})
    h = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    form = F.when((F.length("_text") == 0) | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumns({"_cut": _cuts(every)(F.col("_text"), h[0], h[1]), "form": form})
    lower, upper = F.col("_cut.lower").cast("int"), F.col("_cut.upper").cast("int")
    parts = {"_p": F.substring("_text", F.lit(1), lower), "_m": F.substring("_text", lower + 1, upper - lower), "_s": F.substring("_text", upper + 1, F.length("_text") - upper)}
    p, s, m = (F.concat(F.lit(mark), F.col(c)) for mark, c in ((PREFIX, "_p"), (SUFFIX, "_s"), (MIDDLE, "_m")))
    cut = F.col("form") != "plain"
    rows = rows.withColumns(parts).withColumns({
        "n": F.col("_cut.n"), "prefix_chars": F.when(cut, F.col("_cut.lower")), "middle_chars": F.when(cut, F.col("_cut.upper") - F.col("_cut.lower")),
        "output": F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.concat(p, s, m)),
    })
    return unpacked(rows, docs, own, "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.  A cut text holds no mark, so each mark stands once in its output."""
    part = lambda c, mark, i: F.split_part(c, F.lit(mark), F.lit(i))
    middle, head = part(output, MIDDLE, 2), part(output, MIDDLE, 1)
    psm = F.concat(part(part(head, SUFFIX, 1), PREFIX, 2), middle, part(head, SUFFIX, 2))
    spm = F.concat(part(head, PREFIX, 2), middle, part(part(head, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
