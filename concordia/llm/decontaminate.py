"""Benchmark decontamination over sparse suffix arrays of the training text.

Every shard (a run of documents of about 16 MB) is tokenised, and the suffixes that can begin
a test window are sorted into a suffix array.  *Sparse* means that suffixes whose first words
occur nowhere in the benchmark are left out before sorting; that cannot lose a match.  Every
test suffix is then binary-searched in the array word by word, which gives the range of all
training suffixes that continue it for a whole window.  The longest verbatim match is grown
from the first word of each matching run.

The benchmark is the stated query set.  It reaches the executors in blocks of at most
``BLOCK_WORDS`` words, under 20 bytes each with all that is kept of them, and two filters of 4 MB,
so a broadcast never exceeds 32 MB however large the benchmark is.  An item longer than a block is
cut into pieces that overlap by all but one word of a window, so that no window is lost (a match
is then grown within a piece).  The results of all blocks are merged inside the task that holds
the documents.

Defined results: a null or empty text has no words and is never contaminated; a null benchmark
text, or one without words, has no window; an item id that occurs in several rows counts once;
a null item id reads as the
empty string; repeated document rows are judged one by one; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.llm.common import grams, packed, quoted, spread, texts, unpacked, words

#: Words of the benchmark in one broadcast.
BLOCK_WORDS = 1 << 20
_FILTER_BITS = 22
_LEAD = 4


class Block:
    """Some benchmark items: their words, the test suffixes in them, and filters for training suffixes."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int) -> None:
        self.ids = [i for i, _ in items]
        self.words = np.concatenate([w for _, w in items] + [np.zeros(window, np.uint64)])
        size = np.array([len(w) for _, w in items], np.int64)
        item, rank = spread(np.maximum(size - window + 1, 1))
        self.first, self.size = np.cumsum(size) - size, size  # of each item
        self.item, self.start = item.astype(np.int32), (self.first[item] + rank).astype(np.int32)
        self.depth = np.minimum(size, window)[item].astype(np.int32 if window > 127 else np.int8)
        short = self.depth < _LEAD
        self.any_short = bool(short.any())
        self.lead = np.zeros(1 << _FILTER_BITS, bool)
        self.lead[_slot(grams(self.words, _LEAD)[self.start[~short]])] = True
        self.one = np.zeros(1 << _FILTER_BITS, bool)
        self.one[_slot(self.words[self.start[short]])] = True


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def benchmark_blocks(bench: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Block]:
    """The benchmark's items in blocks; its rows come to the driver a partition at a time."""

    def hashed(batches):
        for b in batches:
            for lo, hi, data, off in texts(b.column(1)):
                h, bound = words(data, off)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([h[bound[i] : bound[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())],
                    ["item", "words"],
                )

    rows = bench.select(F.coalesce(F.col(quoted(item_col)).cast("string"), F.lit("")).alias("item"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(hashed, "item string, words binary")
    held, n = [], 0
    for item, w in rows.where(F.length("words") > 0).toLocalIterator():
        every = np.frombuffer(bytes(w), np.uint64)
        step = max(1, BLOCK_WORDS - window + 1)
        for lo in range(0, max(1, len(every) - window + 1), step):
            piece = every[lo : lo + step + window - 1]
            if held and n + len(piece) > BLOCK_WORDS:
                yield Block(held, window)
                held, n = [], 0
            held.append((item, piece))
            n += len(piece)
    if held:
        yield Block(held, window)


def _suffix_array(h: np.ndarray, last: np.ndarray, pos: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next ``depth`` words, and those words as a matrix (0 after a text's end)."""
    at = pos[:, None] + np.arange(depth)
    key = np.where(at < last[:, None], h[np.minimum(at, len(h) - 1)], np.uint64(0))
    order = np.lexsort(key.T[::-1])
    return pos[order], key[order]


def _bisect(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of want[i] in the sorted column[lo[i]:hi[i]], for all i together."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        v = column[np.minimum(mid, len(column) - 1)]
        down = open_ & ((v <= want) if right else (v < want))
        lo = np.where(down, mid + 1, lo)
        hi = np.where(open_ & ~down, mid, hi)


def _search(key: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test suffixes that continue for their whole window, with their ranges of the suffix array."""
    live = np.arange(len(block.start))
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(key), np.int64)
    out = []
    for d in range(key.shape[1]):
        want, column = block.words[block.start[live] + d], key[:, d]
        lo, hi = _bisect(column, lo, hi, want, False), _bisect(column, lo, hi, want, True)
        some = lo < hi
        live, lo, hi = live[some], lo[some], hi[some]
        done = block.depth[live] == d + 1
        out.append((live[done], lo[done], hi[done]))
        live, lo, hi = live[~done], lo[~done], hi[~done]
        if not len(live):
            break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Hits:
    """What the blocks found in one shard."""

    def __init__(self, n_words: int, n_docs: int) -> None:
        self.cover = np.zeros(n_words + 1, np.int32)
        self.items: list[set[str]] = [set() for _ in range(n_docs)]
        self.longest = np.zeros(n_docs, np.int64)
        self.longest_at = np.zeros(n_docs, np.int64)
        self.longest_item: list[str | None] = [None] * n_docs

    def add(self, h: np.ndarray, bound: np.ndarray, block: Block, window: int) -> None:
        n = len(h)
        if not n:
            return
        keep = np.zeros(n, bool)
        g = grams(h, _LEAD)
        keep[: len(g)] = block.lead[_slot(g)]
        if block.any_short:
            keep |= block.one[_slot(h)]
        pos = np.flatnonzero(keep)
        if not len(pos):
            return
        doc = np.searchsorted(bound, pos, side="right") - 1
        pos, key = _suffix_array(h, bound[doc + 1], pos, window)
        suffix, lo, hi = _search(key, block)
        step = 1 << 12  # test suffixes at a time: a passage of the shard may fit very many of them
        for i in range(0, len(suffix), step):
            own, rank = spread((hi - lo)[i : i + step])
            self._mark(h, bound, block, suffix[i : i + step][own], pos[lo[i : i + step][own] + rank])

    def _mark(self, h, bound, block: Block, j: np.ndarray, p: np.ndarray) -> None:
        np.add.at(self.cover, p, 1)
        np.add.at(self.cover, p + block.depth[j], -1)
        doc = np.searchsorted(bound, p, side="right") - 1
        pairs = np.unique(np.stack([doc, block.item[j]]), axis=1)
        for d, i in pairs.T.tolist():
            self.items[d].add(block.ids[i])
        q = block.start[j]
        head = (p == bound[doc]) | (q == block.first[block.item[j]]) | (h[np.maximum(p - 1, 0)] != block.words[np.maximum(q - 1, 0)])
        p, q, doc, j = p[head], q[head], doc[head], j[head]
        length, end_p, end_q = block.depth[j].astype(np.int64), bound[doc + 1], (block.first + block.size)[block.item[j]]
        live = np.arange(len(p))
        while len(live):
            a, b = p[live] + length[live], q[live] + length[live]
            ok = (a < end_p[live]) & (b < end_q[live])
            ok[ok] = h[a[ok]] == block.words[b[ok]]
            live = live[ok]
            length[live] += 1
        for k in np.lexsort((p, -length)).tolist():
            d = doc[k]
            if length[k] > self.longest[d]:
                self.longest[d], self.longest_at[d], self.longest_item[d] = length[k], p[k] - bound[d], block.ids[block.item[j[k]]]


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items", T.StringType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("longest_match", T.LongType()),
        T.StructField("longest_at", T.LongType()),
        T.StructField("longest_item", T.StringType()),
    ]
)


def _judge(data: np.ndarray, off: np.ndarray, blocks: list, window: int) -> dict[str, list]:
    h, bound = words(data, off)
    n = len(off) - 1
    hits = Hits(len(h), n)
    for b in blocks:
        hits.add(h, bound, b.value, window)
        if len(blocks) > 1 and hasattr(b, "_value"):  # hold one block at a time
            del b._value
    hit = np.concatenate([[0], np.cumsum(np.cumsum(hits.cover[:-1]) > 0)])
    joined = [",".join(sorted(s)) for s in hits.items]
    return {
        "n_words": np.diff(bound), "n_hit": hit[bound[1:]] - hit[bound[:-1]], "n_items": np.array([len(s) for s in hits.items], np.int64),
        "items": joined, "items_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in joined], "contaminated": hit[bound[1:]] > hit[bound[:-1]],
        "longest_match": hits.longest, "longest_at": np.where(hits.longest > 0, hits.longest_at, -1), "longest_item": hits.longest_item,
    }


def _blocks(docs: DataFrame, bench: DataFrame, item_col: str, bench_text: str, window: int) -> list:
    sc = docs.sparkSession.sparkContext
    return [sc.broadcast(b) for b in benchmark_blocks(bench, item_col, bench_text, window)]


def contamination(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = 10
) -> DataFrame:
    """One row per document row: words, hit words, items found, and the longest verbatim match with its place."""
    blocks = _blocks(docs, bench, item_col, bench_text, window)
    types = {f.name: (pa.int64() if isinstance(f.dataType, T.LongType) else pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.string()) for f in _FOUND}

    def judge(batches):
        for b in batches:
            for lo, hi, data, off in texts(b.column(1)):
                found = _judge(data, off, blocks, window)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(found[k], t) for k, t in types.items())], ["_id", *types])

    rows = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).cast("string").alias("_text"))
    return rows.mapInArrow(judge, T.StructType([rows.schema["_id"], *_FOUND])).withColumnRenamed("_id", id_col)


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = 10) -> DataFrame:
    """The document rows without any hit word, with all their columns."""
    blocks = _blocks(docs, bench, item_col, bench_text, window)
    own = {"_text": text_col}
    rows = packed(docs, **own)

    def keep(batches):
        for b in batches:
            for lo, hi, data, off in texts(b.column(0)):
                yield b.slice(lo, hi - lo).filter(pa.array(~_judge(data, off, blocks, window)["contaminated"]))

    return unpacked(rows.mapInArrow(keep, rows.schema), docs, own)
