"""Hard-negative mining: for anchors and their nearest rows of the same label, the best rows of other labels in a score window.

Vectors are turned into their principal axes (an orthogonal rotation, so inner products stay), found
on a bounded sample.  For a block of anchors and a chunk of candidates the products of the leading
components are accumulated; the rest of a product is at most the product of the two residual norms.
A pair whose product can't come into the anchor's score window, rounding allowed for, is dropped
early; once few are left they go on as a list of pairs, and those left at the end are scored in
integers.  Two such searches are made: same label for the positives, whose scores then give the
windows of the search among other labels.

Layout.  Candidates are dealt by a hash to groups of at most ``GROUP_BYTES``; each anchor goes once to
each group.  A task holds its group and streams the anchors past it in blocks, so nothing passes the
driver, nothing is broadcast but the axes, and memory does not grow with either side.  A block leaves
at most as many rows as its results, and a window per anchor merges the groups.

Defined results: rows without a label or vector, or with a null component, take no part, as rows or anchors.  Rows with equal
id, label and vector are held once with their number, and count that often: an anchor's copies are
its neighbours (not itself), and each copy of an anchor has its own results.  Ties go to the smaller
id, null ids last; rows without an id take part.  Vectors of different lengths are padded with zeros.
A positive of negative score has an empty window.  An empty table, or one without anchors, gives no
rows.  A positive's score that a bigint can't hold is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordia.llm.common import quoted, written
from concordia.llm.topk import SAMPLE, Axes, _matrix, _narrowest, exact_scores

#: Bytes of candidates that a task holds; anchors in a block, candidates in a chunk.
GROUP_BYTES, ANCHORS, CANDIDATES = 1 << 27, 512, 4096
#: Share of surviving pairs below which they become a list.
SPARSE = 0.1
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_NO_ID = np.iinfo(np.int64).max


def leads(axes: Axes, sample: np.ndarray, dims: int) -> list[int]:
    """Numbers of leading components at which to stop and drop: where a half, a quarter, ... of the sample's mass is left."""
    if not len(sample):
        return [dims]
    rest = np.square(axes.unit(sample)[1]).mean(axis=1)  # by dimension, of unit vectors
    at = {int(np.argmax(rest <= rest[0] * 0.5**i)) for i in range(1, 7)}
    return sorted({d for d in at if 0 < d < dims} | {dims})


def within(q: tuple, c: tuple, least: np.ndarray, most: np.ndarray | None, steps: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (anchor, candidate) whose product may lie from ``least`` to ``most`` of the anchor, and how many products of components were made.

    ``q`` and ``c`` are what ``Axes.unit`` gives.  ``slack`` is four times the worst rounding of a
    product of unit vectors held in 32 bits.
    """
    (qx, q_rest, q_norm), (cx, c_rest, c_norm) = q, c
    dims, nq, nc = len(qx), qx.shape[1], cx.shape[1]
    slack = np.float32((dims + 16) * 2.0**-22)

    def scaled(bound: np.ndarray, zero: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = ((bound / q_norm)[:, None] / c_norm).astype(np.float32)
        none = (q_norm == 0)[:, None] | (c_norm == 0)  # such a product is zero
        return np.where(none, zero[:, None], out) if none.any() else out

    low = scaled(least, np.where(least > 0, np.inf, -np.inf).astype(np.float32)) - slack
    high = None if most is None else scaled(most, np.where(most < 0, -np.inf, np.inf).astype(np.float32)) + slack
    total, work, d = np.zeros((nq, nc), np.float32), 0, 0
    for n, to in enumerate(steps):
        total += qx[d:to].T @ cx[d:to]
        work, d = work + nq * nc * (to - d), to
        room = np.outer(q_rest[d], c_rest[d])
        open_ = total + room >= low
        if high is not None:
            open_ &= total - room <= high
        if d == dims or np.count_nonzero(open_) < SPARSE * open_.size:
            break
    i, j = np.nonzero(open_)
    if d < dims:
        part, qt, ct = total[i, j], np.ascontiguousarray(qx.T), np.ascontiguousarray(cx.T)
        for to in steps[n + 1 :]:
            part += np.einsum("nd,nd->n", qt[i, d:to], ct[j, d:to])
            work, d = work + len(i) * (to - d), to
            room = q_rest[d][i] * c_rest[d][j]
            keep = part + room >= low[i, j]
            if high is not None:
                keep &= part - room <= high[i, j]
            i, j, part = i[keep], j[keep], part[keep]
    return i, j, work


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, blank: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k first: highest score, then smallest id, rows without an id last."""
    if score.dtype == object:
        order = np.array(sorted(range(len(group)), key=lambda n: (group[n], -score[n], ids[n], blank[n])), np.int64)
    else:
        order = np.lexsort((blank, ids, -score, group))
    if not len(order):
        return order.astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


class Rows:
    """Vectors of a batch or chunk with their ids, labels' codes and numbers of copies."""

    def __init__(self, b: pa.RecordBatch, dims: int, codes: dict, grow: bool) -> None:
        id_ = b.column("id")
        self.blank = np.asarray(id_.is_null())
        self.ids = id_.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        labels = b.column("label").to_pylist()
        self.codes = np.array([codes.setdefault(x, len(codes)) for x in labels] if grow else [codes.get(x, -1) for x in labels], np.int64)
        self.n = b.column("n").to_numpy(zero_copy_only=False)
        self.anchor = b.column("q").to_numpy(zero_copy_only=False)
        self.ints = _matrix(b.column("v"), dims)

    def take(self, at) -> Rows:
        out = Rows.__new__(Rows)
        out.__dict__.update({k: v[at] for k, v in self.__dict__.items()})
        return out

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        out = Rows.__new__(Rows)
        out.__dict__.update({k: np.concatenate([p.__dict__[k] for p in parts]) for k in parts[0].__dict__})
        return out


def _copies(a: Rows, c: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How often candidate j counts for anchor i: once less if it is the anchor itself."""
    n = c.n[j].copy()
    same = np.flatnonzero((a.ids[i] == c.ids[j]) & (a.blank[i] == c.blank[j]) & (a.codes[i] == c.codes[j]) & c.anchor[j])
    n[same] -= (a.ints[i[same]] == c.ints[j[same]]).all(axis=1)
    return n


def _below(x: np.ndarray) -> np.ndarray:
    """A float that is no greater than the integer."""
    return np.nextafter(x.astype(float), -np.inf)


class Found:
    """The best candidates so far of each of ``size`` searches, and what a new one needs to reach at least."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.least, self.k = _below(least), k
        self.rows: tuple[np.ndarray, ...] | None = None

    def add(self, *new: np.ndarray) -> None:
        """``new``: search, score, id, whether it has none, copies."""
        rows = new if self.rows is None else tuple(np.concatenate(x) for x in zip(self.rows, new, strict=True))
        top = first_of_each(*rows[:4], self.k)
        self.rows = tuple(x[top] for x in rows)
        search, score = self.rows[:2]
        count = np.bincount(search, minlength=len(self.least))
        full = np.flatnonzero(count >= self.k)
        if len(full):
            self.least[full] = np.maximum(self.least[full], _below(score[np.cumsum(count)[full] - 1]))


class Group:
    """The candidates of one task, by label, in chunks."""

    def __init__(self, rows: Rows, axes: Axes, steps: list[int], counter) -> None:
        rows = rows.take(np.argsort(rows.codes, kind="stable"))
        self.rows, self.steps, self.counter = rows, steps, counter
        self.units = [axes.unit(rows.ints[lo : lo + CANDIDATES]) for lo in range(0, len(rows.ids), CANDIDATES)]
        self.norm = max((float(u[2].max(initial=0)) for u in self.units), default=0.0)

    def pairs(self, a: Rows, unit: tuple, lo: int, hi: int, least: np.ndarray, most: np.ndarray | None, differ: bool = False):
        """Of candidates lo to hi of one chunk: (anchor, score, id, has none, copies) of pairs whose score may be in range."""
        base, u = lo // CANDIDATES * CANDIDATES, self.units[lo // CANDIDATES]
        cut = slice(lo - base, hi - base)
        i, j, work = within(unit, (u[0][:, cut], u[1][:, cut], u[2][cut]), least, most, self.steps)
        if self.counter is not None:
            self.counter.add(work)
        j += lo
        if differ:
            other = a.codes[i] != self.rows.codes[j]
            i, j = i[other], j[other]
        score = exact_scores(a.ints, self.rows.ints, i, j, float(unit[2].max(initial=0)) * self.norm * 1.001)
        n = np.maximum(_copies(a, self.rows, i, j), 0)
        return i, score, self.rows.ids[j], self.rows.blank[j], n

    def chunks(self, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        while lo < hi:
            to = min(hi, (lo // CANDIDATES + 1) * CANDIDATES)
            yield lo, to
            lo = to

    def positives(self, a: Rows, unit: tuple, k: int) -> tuple | None:
        """The best of the same label."""
        out = Found(np.full(len(a.ids), -np.inf), k)
        for code in np.unique(a.codes[a.codes >= 0]):
            mine = np.flatnonzero(a.codes == code)
            own, x = a.take(mine), (unit[0][:, mine], unit[1][:, mine], unit[2][mine])
            for lo, hi in self.chunks(*np.searchsorted(self.rows.codes, [code, code + 1])):
                i, score, ids, blank, n = self.pairs(own, x, lo, hi, out.least[mine], None)
                some = n > 0
                out.add(mine[i[some]], score[some], ids[some], blank[some], n[some])
        return out.rows

    def negatives(self, a: Rows, unit: tuple, low: np.ndarray, high: np.ndarray, k: int) -> tuple | None:
        """The best of other labels in each of an anchor's windows; a search is (anchor, window)."""
        m = low.shape[1]
        out = Found(low.ravel(), k)
        most = high.max(axis=1).astype(float)
        for lo, hi in self.chunks(0, len(self.rows.ids)):
            least = np.where(low <= high, out.least.reshape(low.shape), np.inf).min(axis=1)
            i, score, ids, blank, n = self.pairs(a, unit, lo, hi, least, most, differ=True)
            for w in range(m):
                at = np.flatnonzero((low[i, w] <= score) & (score <= high[i, w]) & (score >= out.least[i * m + w])) if len(i) else i
                if len(at):
                    out.add(i[at] * m + w, score[at], ids[at], blank[at], n[at])
        return out.rows


def _searched(rows: DataFrame, anchors: DataFrame, groups: int, dims: int, shared, counter, emit: Callable, schema: str) -> DataFrame:
    """``emit(group, anchors of a block, unit vectors, batch)`` for every block of anchors and every group of candidates."""
    names = ["id", "label", "v", "n", "q"]
    extra = [c for c in anchors.columns if c not in names]
    own = rows.select(F.pmod(F.xxhash64("id", "label", "v"), F.lit(groups)).cast("int").alias("group"), F.lit(False).alias("late"), *names, *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra])
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("late"), *names, *extra)
    dealt = own.unionByName(sent).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "late", "label")

    def search(batches):
        axes, steps = shared.value
        group, codes, held, now = None, {}, [], None
        for b in batches:
            numbers = b.column("group").to_numpy()
            late = b.column("late").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(late.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if hi == lo:
                    continue
                part = b.slice(lo, hi - lo)
                if numbers[lo] != now:
                    now, group, codes, held = numbers[lo], None, {}, []
                if not late[lo]:
                    held.append(Rows(part, dims, codes, True))
                    continue
                if group is None:
                    if not held:
                        continue
                    group, held = Group(Rows.joined(held), axes, steps, counter), []
                for at in range(0, part.num_rows, ANCHORS):
                    block = part.slice(at, ANCHORS)
                    a = Rows(block, dims, codes, False)
                    yield from emit(group, a, axes.unit(a.ints), block)

    return dealt.mapInArrow(search, schema)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "v", label_col: str = "label", positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, counter=None
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    For every anchor and each of its ``positives`` best other rows of the same label: the first
    ``negatives`` rows of other labels whose score is from ``least`` to ``most`` hundredths of the
    positive's.  Vectors are arrays of integers.  An accumulator given as ``counter`` gets the number
    of products of components that were made.
    """
    spark = vectors.sparkSession
    whole = ~F.exists(F.col(quoted(vector_col)), lambda x: x.isNull())  # null for a null vector
    usable = vectors.where(F.coalesce(whole, F.lit(False)) & F.col(quoted(label_col)).isNotNull())
    rows = usable.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(label_col)).alias("label"), F.col(quoted(vector_col)).cast("array<bigint>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("q"))
    size = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double")))).first()
    n, dims, largest = (int(x or 0) for x in size)
    if not n or not dims:
        return _of_zeros(rows, positives, negatives) if n else spark.createDataFrame([], _RESULT)
    rows = rows.withColumn("v", F.col("v").cast(f"array<{_narrowest(largest)}>")).groupBy("id", "label", "v", "q").agg(F.count("*").alias("n"))
    rows = written(rows, "vectors")
    few = rows.select(F.xxhash64("id", "v").alias("h"), "v").orderBy("h", "v").limit(SAMPLE).select("v").toArrow()  # SAMPLE rows
    sample = _matrix(pa.concat_arrays(few.column("v").chunks), dims)
    axes = Axes.of(sample, dims)
    shared = spark.sparkContext.broadcast((axes, leads(axes, sample, dims)))
    bytes_ = n * (dims * 12 + 64)
    groups = max(-(-bytes_ // GROUP_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-n // 256)))
    key = F.sha2(F.to_json(F.struct("id", "label", "v")), 256)
    anchors = rows.where("q").withColumn("key", key)

    def first(group: Group, a: Rows, unit: tuple, block: pa.RecordBatch):
        if (found := group.positives(a, unit, positives)) is not None:
            search, score, ids, blank, copies = found
            keys = block.column("key").take(pa.array(search))
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, mask=blank), pa.array(copies), pa.array(score.tolist(), pa.int64())], ["key", "other", "copies", "score"])

    def windows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
        lists = b.column("scores").to_pylist()
        low, high = np.full((len(lists), positives), _NO_ID), np.full((len(lists), positives), -_NO_ID)
        for i, scores in enumerate(lists):
            for w, p in enumerate(scores):
                low[i, w], high[i, w] = -(-least * p // 100), most * p // 100
        return low, high, lists

    def second(group: Group, a: Rows, unit: tuple, block: pa.RecordBatch):
        low, high, scores = windows(block)
        if (found := group.negatives(a, unit, low, high, negatives)) is not None:
            search, score, ids, blank, copies = found
            i, w = search // positives, search % positives
            others = block.column("others").to_pylist()
            columns = [
                block.column("key").take(pa.array(i)), pa.array(w.astype(np.int32)), pa.array(a.ids[i], mask=a.blank[i]), pa.array(a.n[i]), pa.array([others[x][y] for x, y in zip(i.tolist(), w.tolist(), strict=True)], pa.int64()),
                pa.array([scores[x][y] for x, y in zip(i.tolist(), w.tolist(), strict=True)], pa.int64()), pa.array(ids, mask=blank), pa.array(copies), pa.array(score.tolist(), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "w", "anchor_id", "times", "positive_id", "positive_score", "other", "copies", "score"])

    near = _ranked(_searched(rows, anchors, groups, dims, shared, counter, first, "key string, other long, copies long, score long"), ["key"], positives)
    near = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("p"))  # ``positives`` at most
    ready = written(anchors.join(near, "key").select(*anchors.columns, F.col("p.other").alias("others"), F.col("p.score").alias("scores")).where(F.exists("scores", lambda s: s >= 0)), "anchors")
    schema = "key string, w int, anchor_id long, times long, positive_id long, positive_score long, other long, copies long, score long"
    best = _ranked(_searched(rows, ready, groups, dims, shared, counter, second, schema), ["key", "w"], negatives)
    best = best.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))  # each copy of an anchor
    return best.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _ranked(found: DataFrame, of: list[str], k: int) -> DataFrame:
    """The first k of each search over all groups, each candidate as often as it counts."""
    found = found.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    order = W.partitionBy(*of).orderBy(F.desc("score"), F.asc_nulls_last("other"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _of_zeros(rows: DataFrame, positives: int, negatives: int) -> DataFrame:
    """Only empty vectors: every score is zero, so a component of zero says the same."""
    padded = rows.select("id", "label", "q", F.array(F.lit(0)).alias("v"))
    return hard_negatives(padded, F.col("q"), "id", "v", "label", positives, negatives)
