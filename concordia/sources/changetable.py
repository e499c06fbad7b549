"""A change table as a stream whose offsets are log positions at transaction boundaries (SRC8, STR9).

The table is a folder of Parquet files of envelopes, to which a source's capture appends.  A batch
always ends with a whole transaction: an offset is the commit position of the last transaction up to
and with which everything was read, so a stream that begins again, wherever it was stopped, begins at
the start of a transaction.  The last transaction in the table counts as whole once a later record,
a heartbeat for one, is there.

Admission: a batch takes at most ``transactions`` transactions, none if that is 0.  Files are looked
up by their footers' statistics, and each task reads a row group; folders may be on any file system
that Arrow opens.  Use it as ``changes(spark, folder)``, or by its format's name after registering it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from concordia.sources.envelope import parsed

SCHEMA = "kind string, stream_lsn string, schema string, table string, op string, commit_lsn string, change_lsn string, event_serial_no long, commit_at timestamp_ntz, before map<string,string>, after map<string,string>"
_IMAGE = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema(
    [(c, pa.string()) for c in ("kind", "stream_lsn", "schema", "table", "op", "commit_lsn", "change_lsn")] + [("event_serial_no", pa.int64()), ("commit_at", pa.timestamp("us")), ("before", _IMAGE), ("after", _IMAGE)]
)


@dataclass
class Piece(InputPartition):
    """A row group of a file, and the positions to read of it: after ``low``, or from it on, up to ``high``."""

    path: str
    group: int
    low: str
    inclusive: bool
    high: str


def _opened(folder: str) -> tuple[pf.FileSystem, str]:
    if folder.startswith(("file:", "/")):
        return pf.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    return pf.FileSystem.from_uri(folder)


def _position(t: pa.Table | pa.RecordBatch) -> pa.Array:
    """A change's position is its commit's; other records have the stream's.  A file may lack one of the columns."""
    there = [t.column(c) for c in ("commit_lsn", "stream_lsn") if c in t.schema.names]
    return pc.coalesce(*there) if len(there) > 1 else there[0]


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.limit = options["path"], int(options.get("transactions", "1000"))
        self.first, self.progress = options.get("startingposition", ""), options.get("progress")
        self.fs, self.base = _opened(self.folder)
        self.groups: dict[str, list[tuple[int, str, str]]] = {}  # by file: row group, least and greatest position
        self.at = self._stored() or self.initialOffset()

    def _stored(self) -> dict | None:
        """Where the stream had got to, from the file that ``commit`` leaves in the folder ``progress``."""
        if self.progress:
            fs, path = _opened(f"{self.progress.rstrip('/')}/offset.json")
            if fs.get_file_info(path).type == pf.FileType.File:
                with fs.open_input_stream(path) as f:
                    return json.loads(f.read().decode())
        return None

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"lsn": self.first, "inclusive": bool(self.first)}

    def _look(self) -> None:
        """Footers of files not seen yet; files never change."""
        for f in self.fs.get_file_info(pf.FileSelector(self.base, recursive=True, allow_not_found=True)):
            name = f.path.rsplit("/", 1)[-1]
            if f.type != pf.FileType.File or not name.endswith(".parquet") or name.startswith(("_", ".")) or f.path in self.groups:
                continue
            meta = pq.read_metadata(self.fs.open_input_file(f.path))
            columns = [meta.schema.column(i).path for i in range(meta.num_columns)]
            found = []
            for g in range(meta.num_row_groups):
                stats = [s for c in ("commit_lsn", "stream_lsn") if c in columns and (s := meta.row_group(g).column(columns.index(c)).statistics) is not None and s.has_min_max]
                if stats:
                    found.append((g, min(s.min for s in stats), max(s.max for s in stats)))
            self.groups[f.path] = found

    def _beyond(self, low: str, inclusive: bool) -> list[tuple[str, str, str, int]]:
        """Row groups with positions after ``low``: least, greatest, file, number; by least position."""
        self._look()
        return sorted((a, b, path, g) for path, found in self.groups.items() for g, a, b in found if b > low or (inclusive and b == low))

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the next batch: the last whole transaction, or the last of as many as a batch may take."""
        low, inclusive = self.at["lsn"], self.at["inclusive"]
        near = self._beyond(low, inclusive)
        top = max((b for _, b, _, _ in near), default=None)
        seen: set[str] = set()
        for i, (_, _, path, g) in enumerate(near):
            p = _position(pq.ParquetFile(self.fs.open_input_file(path)).read_row_group(g, columns=["commit_lsn", "stream_lsn"]))
            p = p.filter(pc.greater_equal(p, low) if inclusive else pc.greater(p, low)).unique().to_pylist()
            seen |= {x for x in p if x < top}
            if self.limit and i + 1 < len(near) and len([x for x in seen if x < near[i + 1][0]]) >= self.limit:
                break  # later row groups have later positions only
        order = sorted(seen)
        if order:
            self.at = {"lsn": order[min(self.limit or len(order), len(order)) - 1], "inclusive": False}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.at = end
        near = self._beyond(start["lsn"], start["inclusive"])
        return [Piece(path, g, start["lsn"], start["inclusive"], end["lsn"]) for a, _, path, g in near if a <= end["lsn"] and start != end]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.folder)
        file = pq.ParquetFile(fs.open_input_file(partition.path))
        for batch in file.iter_batches(row_groups=[partition.group]):
            p = _position(batch)
            low = pc.greater_equal(p, partition.low) if partition.inclusive else pc.greater(p, partition.low)
            kept = pa.Table.from_batches([batch]).filter(pc.and_(low, pc.less_equal(p, partition.high)))
            columns = [kept.column(f.name).cast(f.type) if f.name in kept.schema.names else pa.nulls(len(kept), f.type) for f in _ARROW]
            yield from pa.table(columns, schema=_ARROW).combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        if self.progress:
            fs, folder = _opened(self.progress.rstrip("/"))
            fs.create_dir(folder)
            with fs.open_output_stream(f"{folder}/offset.new") as f:
                f.write(json.dumps(end).encode())
            fs.move(f"{folder}/offset.new", f"{folder}/offset.json")


class ChangeTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_table"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:  # noqa: N802 - Spark's name
        return Reader(dict(self.options))


def changes(spark: SparkSession, folder: str, transactions: int = 1000, progress: str | None = None, start: str | None = None) -> DataFrame:
    """The stream of parsed events.  ``progress`` is a folder of the stream's own, beside its checkpoint, so that admission goes on after a restart; ``start`` a position to begin at, with its whole transaction."""
    spark.dataSource.register(ChangeTable)
    reader = spark.readStream.format(ChangeTable.name()).option("transactions", transactions)
    for k, v in (("progress", progress), ("startingPosition", start)):
        if v:
            reader = reader.option(k, v)
    return parsed(reader.load(folder))
