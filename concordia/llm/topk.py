"""Exact top-k search by inner product: columnar branch and bound.

Vectors are brought to unit length and turned into the axes of the most mass, found on a bounded
sample, and lie by dimension.  For a chunk of candidates and a block of queries the products are
accumulated block by block of dimensions; after each, a candidate whose product so far plus the
most that the remaining dimensions can add, by the Cauchy-Schwarz bound on the remaining masses
of query and candidate, is below the query's k-th best known score cannot be a result.  While
most pairs survive, whole columns go on; once few do, the survivors are compacted into a list of
pairs, and only these go on.  Pairs that are left at the end are scored in exact integers.

Bounds.  A first round scores every query against a sample of ``SAMPLE`` candidates, so every task
starts from a k-th best score that is known to exist, and a task raises it as it goes.

Layout.  Candidates are dealt by a hash to groups of at most ``GROUP_BYTES``; the queries stay a table,
of which each group gets every row once.  A task holds its group and streams the queries past it in
blocks of ``QUERIES`` rows or ``BLOCK_BYTES``, so nothing but the sample is broadcast, nothing passes
the driver, and memory grows with neither side.  A block leaves at most k rows a query, and a window
per query merges the groups.

Integers are stored in as few bytes as the largest component needs.  The bounds are floating
point with room for rounding; scores are exact, in 64-bit integers or, for vectors whose product
could pass those, in Python integers.  A result's score that a bigint can't hold is an error.

Defined results: null vectors take no part.  Rows with equal ids are one vector, the least of them,
and rows without an id take no part; or with ``every_row`` each row takes part: it is a candidate of
every query row but itself, and each query row has k results of its own.  Equal rows are held once
with their number.  Vectors of different lengths are padded with zeros; ties go to the smaller id,
null ids last; fewer candidates than k are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordia.llm.common import written

#: Queries in a block and bytes of it, candidates in a chunk, dimensions between two bounds, candidates of the first round.
QUERIES, BLOCK_BYTES, CANDIDATES, DIMENSIONS, SAMPLE = 4096, 1 << 25, 2048, 8, 4096
#: Bytes of candidates that a task holds.
GROUP_BYTES = 1 << 27
#: Share of surviving pairs below which they become a list; dimensions up to which axes are turned.
SPARSE, TURNED = 0.3, 1024
#: Stands for a missing id, after all others.
NO_ID = (1 << 63) - 1
#: Room for rounding in products of unit vectors held in 32 bits.
_SLACK = 1e-5


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows of one width."""
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), dims), flat.dtype)
    out[np.arange(dims) < size[:, None]] = flat
    return out


@dataclass
class Axes:
    """The turn into axes of falling mass, or for very long vectors an order of dimensions."""

    turn: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, dims: int) -> Axes:
        x = sample.astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        if dims <= TURNED and len(x):
            return cls(np.linalg.eigh(x.T @ x)[1][:, ::-1].astype(np.float32))
        return cls(np.argsort(-(x * x).sum(axis=0), kind="stable"))

    def unit(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors by dimension, the mass of each from dimension d on, and the norms."""
        x = m.astype(float)
        norm = np.linalg.norm(x, axis=1)
        x = (x / np.maximum(norm, 1e-300)[:, None]).astype(np.float32)
        x = np.ascontiguousarray((x @ self.turn if self.turn.ndim == 2 else x[:, self.turn]).T)
        rest = np.sqrt(np.concatenate([np.cumsum((x * x)[::-1], axis=0)[::-1], np.zeros((1, x.shape[1]), np.float32)]))
        return x, rest, norm


def exact_scores(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of the rows q[i] and c[j]; ``largest`` bounds the product of their norms."""
    if largest < 2.0**62:
        out = np.empty(len(i), np.int64)
        for lo in range(0, len(i), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            out[at] = np.einsum("nd,nd->n", q[i[at]].astype(np.int64), c[j[at]].astype(np.int64))
        return out
    return np.array([sum(a * b for a, b in zip(q[x].tolist(), c[y].tolist(), strict=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], object)


def survivors(q: tuple, c: tuple, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, candidate) whose product may reach the query's bound, and how many products of components were made.

    ``q`` and ``c`` are what ``Axes.unit`` gives.
    """
    (qx, q_rest, q_norm), (cx, c_rest, c_norm) = q, c
    dims, work = len(qx), 0
    with np.errstate(divide="ignore", invalid="ignore"):
        bar = np.where(q_norm > 0, least / q_norm, np.where(least > 0, np.inf, -np.inf))
        bar = (bar[:, None] / c_norm).astype(np.float32)  # of the unit vectors' product
    zero = c_norm == 0
    if zero.any():
        bar[:, zero] = np.where(least > 0, np.inf, -np.inf)[:, None]
    bar -= np.float32(_SLACK)
    total = np.zeros((qx.shape[1], cx.shape[1]), np.float32)
    d = 0
    while d < dims:
        to = min(dims, d + DIMENSIONS)
        total += qx[d:to].T @ cx[d:to]
        work += total.size * (to - d)
        d = to
        if 2 * d < dims and d < dims:  # nearly all survive until half of the mass is in
            continue
        open_ = total + np.outer(q_rest[d], c_rest[d]) >= bar
        if d == dims or open_.mean() < SPARSE:
            break
    i, j = np.nonzero(open_)
    if d < dims:
        part, qt, ct = total[i, j], np.ascontiguousarray(qx.T), np.ascontiguousarray(cx.T)
        while d < dims and len(i):
            to = min(dims, d + DIMENSIONS)
            part += np.einsum("nd,nd->n", qt[i, d:to], ct[j, d:to])
            work += len(i) * (to - d)
            d = to
            keep = part + q_rest[d][i] * c_rest[d][j] >= bar[i, j]
            i, j, part = i[keep], j[keep], part[keep]
    return i, j, work


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query i: highest score, then smallest id."""
    order = np.lexsort((ids, -score, i)) if score.dtype != object else np.array(sorted(range(len(i)), key=lambda n: (i[n], -score[n], ids[n])), np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(i[order]) != 0])) if len(i) else np.empty(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    return order[rank < k]


@dataclass
class Block:
    """Some queries: ids, integers, unit vectors with their masses, and for each a score that k candidates reach."""

    ids: np.ndarray
    ints: np.ndarray
    unit: tuple
    least: np.ndarray

    def search(self, c_ids: np.ndarray, c: np.ndarray, unit: tuple, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query's place, id, score) of the best candidates of other ids that reach the bounds ``least``."""
        i, j, score, work = self.places(c, unit, least, k, lambda i, j: self.ids[i] != c_ids[j], c_ids)
        return i, c_ids[j], score, work

    def places(self, c: np.ndarray, unit: tuple, least: np.ndarray, k: int, other, c_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query's place, candidate's place, score) of the best of the pairs that ``other`` lets through."""
        i, j, work = survivors(self.unit, unit, least)
        fit = other(i, j)
        i, j = i[fit], j[fit]
        largest = float(self.unit[2].max(initial=0)) * float(unit[2].max(initial=0))
        score = exact_scores(self.ints, c, i, j, largest * 1.001)
        top = _best(i, c_ids[j], score, k)
        return i[top], j[top], score[top], work


def _raised(least: np.ndarray, held: tuple | None, found: tuple, k: int) -> tuple[np.ndarray, tuple]:
    """Higher bounds from what a task has found so far: (query's place, id, score, ...) of each."""
    rows = found if held is None else tuple(np.concatenate(x) for x in zip(held, found, strict=True))
    top = _best(*rows[:3], k)
    rows = tuple(x[top] for x in rows)
    count = np.bincount(rows[0], minlength=len(least))
    full = np.flatnonzero(count >= k)
    if len(full):
        least = least.copy()
        least[full] = np.maximum(least[full], np.nextafter(rows[2][np.cumsum(count)[full] - 1].astype(float), -np.inf))
    return least, rows


def _narrowest(most: int) -> str:
    return next((t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)) if most < 1 << bits), "bigint")


@dataclass
class Chunk:
    """Some rows: ids (``blank`` where there is none), integers, numbers of equal rows, whether they are queries, unit vectors."""

    ids: np.ndarray
    blank: np.ndarray
    ints: np.ndarray
    n: np.ndarray
    query: np.ndarray
    unit: tuple

    @classmethod
    def of(cls, b: pa.RecordBatch, axes: Axes, dims: int) -> Chunk:
        ids, ints = b.column("id"), _matrix(b.column("v"), dims)
        return cls(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), ints, b.column("n").to_numpy(), b.column("q").to_numpy(zero_copy_only=False), axes.unit(ints))

    def counted(self, q: Chunk):
        """A function of pairs (query, candidate of this chunk): how often the candidate counts, which is once less for the query itself."""

        def copies(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            n = self.n[j].copy()
            same = np.flatnonzero((q.ids[i] == self.ids[j]) & (q.blank[i] == self.blank[j]) & self.query[j])
            n[same] -= (q.ints[i[same]] == self.ints[j[same]]).all(axis=1)
            return n

        return copies


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "v", every_row: bool = False, counter=None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every query row, the k candidates of the highest inner product but itself.

    An accumulator given as ``counter`` gets the number of products of components that were made.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    if not every_row:
        rows = rows.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("v", "q")).alias("r")).select("id", "r.v", "r.q")
    size = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double")))).first()
    n, dims, most = int(size[0]), max(1, int(size[1] or 0)), int(size[2] or 0)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = _narrowest(most)
    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    rows = written(rows.groupBy("id", "v", "q").agg(F.count("*").alias("n")) if every_row else rows.withColumn("n", F.lit(1).cast("long")), "vectors")
    few = rows.select(F.xxhash64("id", "v").alias("h"), "id", "v").orderBy("h", "id", "v").limit(SAMPLE).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "v").toArrow()  # SAMPLE rows
    sample_ids, sample = few.column("id").to_numpy(), _matrix(pa.concat_arrays(few.column("v").chunks), dims)
    axes = Axes.of(sample, dims)
    first = spark.sparkContext.broadcast((sample_ids, sample, axes))

    def bounds(batches):
        ids, m, axes = first.value
        unit = axes.unit(m)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                own, ints = part.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False), _matrix(part.column("v"), dims)
                q = axes.unit(ints)
                score = (q[0].T @ unit[0]) * np.outer(q[2], unit[2]) - _SLACK * np.outer(q[2], unit[2])  # never above the exact one
                score[own[:, None] == ids] = -np.inf  # itself, and what shares its id: the bound holds without them
                least = np.sort(score, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(ints), -np.inf)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least)], [*part.schema.names, "least"])

    key = F.sha2(F.to_json(F.struct("id", "v")), 256)
    queries = rows.where("q").select("id", "v", "n", key.alias("key")).mapInArrow(bounds, f"id long, v array<{kind}>, n long, key string, least double")
    queries = written(queries, "queries")
    groups = max(-(-n * (dims * 12 + 64) // GROUP_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-n // 256)))
    own = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("group"), F.lit(False).alias("late"), "id", "v", "n", "q", F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("least"))
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("late"), "id", "v", "n", F.lit(True).alias("q"), "key", "least")
    dealt = own.unionByName(sent).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "late")
    width = min(QUERIES, max(1, BLOCK_BYTES // (12 * max(dims, 1))))

    def search(batches):
        axes, chunks, now = first.value[2], [], None
        for b in batches:
            group, late = b.column("group").to_numpy(), b.column("late").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(group) != 0) | (np.diff(late.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if group[lo] != now:
                    now, chunks = group[lo], []
                if not late[lo]:
                    for at in range(lo, hi, CANDIDATES):
                        chunks.append(Chunk.of(b.slice(at, min(CANDIDATES, hi - at)), axes, dims))
                    continue
                for at in range(lo, hi, width):
                    yield from found(b.slice(at, min(width, hi - at)), chunks, axes)

    def found(b: pa.RecordBatch, chunks: list[Chunk], axes: Axes):
        q = Chunk.of(b, axes, dims)
        block = Block(q.ids, q.ints, q.unit, b.column("least").to_numpy())
        least, best = block.least, None
        for c in chunks:
            copies = c.counted(q)
            i, j, score, work = block.places(c.ints, c.unit, least, k, lambda i, j: copies(i, j) > 0, c.ids)  # noqa: B023 - used at once
            if counter is not None:
                counter.add(work)
            least, best = _raised(least, best, (i, c.ids[j], score, c.blank[j], copies(i, j)), k)
        if best is not None and len(best[0]):
            i, ids, score, blank, copies = best
            columns = [b.column("key").take(pa.array(i)), pa.array(q.ids[i], mask=q.blank[i]), pa.array(q.n[i]), pa.array(ids, mask=blank), pa.array(copies), pa.array(score.tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "query_id", "times", "vec_id", "copies", "score"])

    best = dealt.mapInArrow(search, "key string, query_id long, times long, vec_id long, copies long, score long")
    best = best.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))  # each candidate as often as it stands in the table
    order = W.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return best.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")
