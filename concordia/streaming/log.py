"""The captured log as parts of ascending positions with an index (SNK2, SRT1, STR3).

A captured batch is a folder of files, each a part.  Its index, a file beside the manifest, says of
each part and table the first and last position, the number of events and the first commit time.
An index never changes, so it is read once by a process.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from concordia.functions import lsn
from concordia.sources.store import Store

LOG = "commit_lsn string, change_lsn string, event_serial_no long, op string, table_name string, before map<string,struct<v:string,unavailable:boolean>>, after map<string,struct<v:string,unavailable:boolean>>, src_commit_at timestamp_ntz"
#: A position before every other.
BEFORE_ALL = ["", "", -1]
_known: dict[tuple[str, str], list] = {}
_reading = threading.Lock()  # a status is told while batches are applied


@dataclass(frozen=True)
class Part:
    """Some events of the log: by table their first and last position, number and first commit time."""

    path: str
    tables: dict[str, list] = field(default_factory=dict)
    #: Whether ``count`` may say too much, since a table is applied up to a position inside the part.
    halfway: bool = False

    @property
    def first(self) -> list:
        return min(t[0] for t in self.tables.values())

    @property
    def last(self) -> list:
        return max(t[1] for t in self.tables.values())

    @property
    def count(self) -> int:
        return sum(t[2] for t in self.tables.values())

    @property
    def began(self) -> dict[str, str | None]:
        return {t: x[3] for t, x in self.tables.items()}

    def of(self, applied: dict[str, list]) -> Part | None:
        """What may be pending in it for the given tables, by their applied positions."""
        left = {t: x for t, x in self.tables.items() if t in applied and x[1] > applied[t]}
        if not left:
            return None
        inside = {t: applied[t] for t, x in left.items() if applied[t] >= x[0]}
        return Part(self.path, {t: [max(x[0], inside.get(t, x[0])), *x[1:]] for t, x in left.items()}, bool(inside))


def indexed(store: Store, path: str) -> dict | None:
    """The log's entry for a folder just written, and its index; None if it holds nothing."""
    rows = store.spark.read.schema(LOG).parquet(f"{store.root}/{path}")
    name = F.col("_metadata.file_name").alias("file")
    found = rows.groupBy(name, F.lower("table_name").alias("t")).agg(F.min(lsn.position()).alias("first"), F.max(lsn.position()).alias("last"), F.count("*").alias("n"), F.min("src_commit_at").cast("string").alias("at")).collect()  # a row per part and table
    if not found:
        store.drop(path)
        return None
    parts: dict[str, dict] = {}
    first, last, count = {}, {}, {}
    for r in found:
        lo, hi, t = list(r["first"]), list(r["last"]), r["t"]
        parts.setdefault(r["file"], {})[t] = [lo, hi, r["n"], r["at"]]
        first[t], last[t], count[t] = min(lo, first.get(t, lo)), max(hi, last.get(t, hi)), count.get(t, 0) + r["n"]
    index = store.put_json("index/log", [{"path": f"{path}/{f}", "tables": ts} for f, ts in sorted(parts.items())])
    return {"path": path, "index": index, "rows": sum(count.values()), "first": first, "last": last, "count": count}


def parts_of(store: Store, log: list[dict]) -> list[Part]:
    """All parts of the log's batches."""
    out, named = [], {b["index"] for b in log}
    with _reading:
        for b in log:
            known = (store.root, b["index"])
            if known not in _known:
                _known[known] = [Part(p["path"], p["tables"]) for p in store.get_json(b["index"])]
            out += _known[known]
        for gone in [k for k in _known if k[0] == store.root and k[1] not in named]:
            del _known[gone]
    return out


@dataclass(frozen=True)
class Cut:
    """Parts to open for a batch.  Up to ``sure`` there are no more events than fit in it (``count`` of them, None if that must be counted), up to ``end`` enough; ``whole``: all events fit."""

    open: list[Part]
    end: list = field(default_factory=lambda: BEFORE_ALL)
    sure: list = field(default_factory=lambda: BEFORE_ALL)
    count: int | None = 0
    whole: bool = True


def find_head(parts: list[Part], n: int) -> Cut:
    """Which parts hold the first n events, by counts alone.

    Parts may overlap and counts be too high.  All events of the parts that end by a position lie
    before it, so once their sure numbers reach n, no event after it belongs to the head; and before
    the first position of a part, only parts that begin earlier have events.
    """
    if not parts:
        return Cut([])
    by_last = sorted(parts, key=lambda p: p.last)
    held, end = 0, None
    for p in by_last:
        held += 0 if p.halfway else p.count
        if held >= n:
            end = p.last
            break
    if end is None and sum(p.count for p in parts) <= n:
        return Cut(parts, by_last[-1].last)
    end = end or by_last[-1].last
    opened = sorted((p for p in parts if p.first <= end), key=lambda p: p.first)
    sure, count, held, reach = BEFORE_ALL, 0, 0, BEFORE_ALL
    exact = True
    for i, p in enumerate(opened):  # up to the last position of those so far, if the next begins after it
        held, exact, reach = held + p.count, exact and not p.halfway, max(reach, p.last)
        if held > n:
            break
        if reach <= end and (i + 1 == len(opened) or opened[i + 1].first > reach):
            sure, count = reach, held if exact else None
    return Cut(opened, end, sure, count, False)
