"""Shared pieces: the folder all machines see, and NumPy kernels over Arrow text buffers.

The kernels work on the UTF-8 bytes of a column in place, so no Python string is made.
A *word* is a maximal run of digits, ASCII letters (lower-cased) and non-ASCII characters;
it is carried as a 64-bit hash.  Equal words always have equal hashes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one pass of the kernels holds; a longer document is cut between words.
PIECE = 1 << 20


# ---------------------------------------------------------------- shared folder

_local: dict[str, str] = {}
_made: list[str] = []
_owner: ContextVar[list[str]] = ContextVar("owner", default=_made)


@contextmanager
def owned(tables: list[str]):
    """Inside, ``written`` notes its folders in ``tables``, for ``release`` once nothing reads them any more; each thread has its own."""
    before = _owner.set(tables)
    try:
        yield tables
    finally:
        _owner.reset(before)


@contextmanager
def interim(spark: SparkSession):
    """Deletes at its end the tables written inside, but those that are passed through the function it gives."""
    outer, mine, kept = _owner.get(), [], []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(mine[-1])
        return table

    with owned(mine):
        try:
            yield keep
        except BaseException:
            kept.clear()
            raise
        finally:
            outer += kept
            release(spark, [f for f in mine if f not in kept])


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only a local session may go without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _local.setdefault("base", tempfile.mkdtemp(prefix="concordia-") if not _local else "")
    return f"{base.rstrip('/')}/concordia-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    folder = shared_folder(df.sparkSession)
    _owner.get().append(folder)
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete what ``written`` made, once nothing will read it again."""
    folders = {f.rsplit("/", 2)[0] for f in df.inputFiles()}
    release(df.sparkSession, [f for f in folders if f.rsplit("/", 1)[1].startswith("concordia-")])


def release(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders that ``written`` has made."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in list(folders):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        for held in (folders, _owner.get()):
            name = folder.rsplit("/", 1)[1]
            held[:] = [f for f in held if f.rsplit("/", 1)[1] != name]


# ---------------------------------------------------------------- columns


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, **own: str) -> DataFrame:
    """Columns under the operator's own names, and all other columns out of the way in the struct ``_row``.

    Whatever the other columns are called, they cannot clash with the operator's.
    """
    rest = [F.col(quoted(c)) for c in df.columns if c not in own.values()]
    return df.select(*[F.col(quoted(c)).alias(k) for k, c in own.items()], F.struct(F.lit(0).alias("_"), *rest).alias("_row"))


def unpacked(df: DataFrame, like: DataFrame, own: dict[str, str], *more: str) -> DataFrame:
    """The columns of ``like`` in their order, then the new columns ``more``, which replace any of the same name."""
    back = {c: k for k, c in own.items()}
    old = [F.col(quoted(back[c]) if c in back else "_row." + quoted(c)).alias(c) for c in like.columns if c not in more]
    return df.select(*old, *more)


_SUM_BLOCK = 128


def with_running_sums(rows: DataFrame, lengths: str, out: str) -> DataFrame:
    """``out``: for each element of the int array ``lengths``, the sum up to and with it.

    Whole blocks are summed first, then the rest of a block, so an array of m elements costs
    about 64 m steps.  Every step is a column that the next one reads more than once, which
    keeps the optimiser from moving it into the per-element functions.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    block = lambda i: F.floor(i / _SUM_BLOCK).cast("int")
    some = lambda c, value: F.when(F.size(c) > 0, value).otherwise(F.array().cast("array<int>"))
    sums, before = f"{out}_b", f"{out}_q"
    rows = rows.withColumn(sums, some(lengths, F.transform(F.sequence(F.lit(0), block(F.size(lengths) - 1)), lambda b: total(F.slice(lengths, b * _SUM_BLOCK + 1, _SUM_BLOCK)))))
    rows = rows.withColumn(before, some(sums, F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i)))))
    inside = lambda i: total(F.slice(lengths, block(i) * _SUM_BLOCK + 1, i % _SUM_BLOCK + 1))
    return rows.withColumn(out, some(before, F.transform(lengths, lambda _, i: F.get(before, block(i)) + inside(i)))).drop(sums, before)


# ---------------------------------------------------------------- words

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    value = np.zeros(256, np.uint64)
    for b in range(256):
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            value[b] = b + 1
        elif 65 <= b <= 90:
            value[b] = b + 33
    return value, value > 0


_VALUE, _IS_WORD = _byte_tables()
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        m = max(n, PIECE + 4096)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _words_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes of the words of one piece; no word runs over a cut."""
    n = len(data)
    up, down = _power(n)
    inside = _IS_WORD[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts[cuts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after)
    total = np.cumsum(_VALUE[data] * up[:n], dtype=np.uint64)
    h = total[end]
    first = start > 0
    h[first] -= total[start[first] - 1]
    h *= down[start]
    h += (end - start).astype(np.uint64) << _U(56)
    h = mix(h)
    h[h == 0] = 1  # 0 means "no word"
    return h, start, end + 1


def words(data: np.ndarray, offsets: np.ndarray, with_bytes: bool = False):
    """Word hashes of the texts ``data[offsets[i]:offsets[i+1]]``, and where each text's words begin.

    Returns ``(hash, bound)`` with ``hash[bound[i]:bound[i+1]]`` the words of text i; with
    ``with_bytes`` also each word's first byte and end byte within ``data``.
    """
    n, at, parts = int(offsets[-1]), int(offsets[0]), []
    while at < n:
        to = min(n, at + PIECE)
        if to < n and not np.any(offsets == to):
            more = np.flatnonzero(~_IS_WORD[data[to : to + 4096]])
            while not len(more) and to < n:
                to = min(n, to + 4096)
                more = np.flatnonzero(~_IS_WORD[data[to : to + 4096]])
            to = to + int(more[0]) if len(more) else n
        lo, hi = np.searchsorted(offsets, at, side="left"), np.searchsorted(offsets, to, side="right")
        h, s, e = _words_of(data[at:to], offsets[lo:hi] - at)
        parts.append((h, s + at, e + at))
        at = to
    if parts:
        h, s, e = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
    else:
        h, s, e = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    bound = np.searchsorted(s, offsets)
    return (h, bound, s, e) if with_bytes else (h, bound)


def texts(column: pa.Array | pa.ChunkedArray, most: int = 16 * PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column of about ``most`` bytes: (first row, end row, bytes, offsets). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_MIXERS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of the concatenated texts; the caller drops those that cross texts."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out *= _U(_BASE)
        out += h[j : j + m] ^ (h[j : j + m] >> _U(29)) * _U(_MIXERS[j % len(_MIXERS)])
    return mix(out)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 0, 1]: owners [0, 0, 2] and ranks [0, 1, 0]."""
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return owner, np.arange(len(owner)) - np.repeat(ends - counts, counts)
