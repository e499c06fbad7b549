"""Quality classifier with hierarchical empirical Bayes over sites.

Evidence of one document: a logistic regression on a few shape measures of the text and on the
presence of the words, and beginnings of words, that tell the labelled classes apart.  A document is *clean* if its
quality label is 1 and its toxic label is 0.

Sites: documents belong to a host and, in it, a path.  The expected share of clean documents of
a host is shrunk toward the corpus, that of a path toward its host; the strength of each prior
comes from the corpus itself (method of moments on grouped sums).  A document's own evidence is
left out of its path's share.  The log-odds of the path against the corpus shift the document's
log-odds, and a document is kept if the result is at least even.

Bound: the model is fitted on at most ``SAMPLE`` labelled documents, the least by a hash of the
id; shape, words and weights are a few hundred numbers.  Scores and site statistics cover every
document.

Defined results: a null or empty text has no words and gets the evidence of its shape alone;
null host or path is a site like any other; of documents with one id the least text is fitted on,
and labels of one id that differ count as not clean; label rows with a null id or quality are left out,
a null toxic label is 0; without labels of both classes every document's evidence is even and
all are kept; repeated rows are scored one by one and all count in their site.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.llm.common import PIECE, interim, mix, packed, quoted, texts, unpacked, words, written

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
#: Words that the model knows, at most; each must occur in so many labelled documents and differ between the classes by so many standard errors.
VOCABULARY, LEAST_DOCUMENTS, STANDARD_ERRORS = 512, 5, 5.0
#: Bytes of the word beginnings that are looked at besides whole words.
PREFIX = 4
_MEASURES = 7
#: Sites (one short row each) that are broadcast to the documents, at most.
_BROADCAST_SITES = 50_000


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weight: np.ndarray  # of the measures, then of the words
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def logit(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        x, present = features(data, off, self.words)
        z = self.bias + ((x - self.mean) / self.scale) @ self.weight[:_MEASURES]
        np.add.at(z, present[0], self.weight[_MEASURES:][present[1]])
        return z


def _count(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[off[1:]] - total[off[:-1]]


def _signs(data: np.ndarray, h: np.ndarray, bound: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and of the beginning of every longer word."""
    owner = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    longer = end - start > PREFIX
    at, head = start[longer], np.zeros(int(longer.sum()), np.uint64)
    for k in range(PREFIX):
        head = head * np.uint64(257) + (data[at + k] | np.uint8(32))
    return np.concatenate([owner, owner[longer]]), np.concatenate([h, mix(head + np.uint64(1 << 50))])


def _distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) without repeats."""
    order = np.lexsort((h, owner))
    o, w = owner[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1])
    return o[new], w[new]


def features(data: np.ndarray, off: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Shape measures of each text, and which known words occur in it."""
    h, bound, start, end = words(data, off, with_bytes=True)
    n = np.maximum(np.diff(bound), 1).astype(float)
    size = np.maximum(np.diff(off), 1).astype(float)
    space = (data <= 32).astype(np.int32)
    upper = ((data >= 65) & (data <= 90)).astype(np.int32)
    digit = ((data >= 48) & (data <= 57)).astype(np.int32)
    letter = ((data >= 97) & (data <= 122) | (data >= 128)).astype(np.int32)
    mark = 1 - space - upper - digit - letter
    same = np.zeros(len(h), np.int32)
    same[1:] = h[1:] == h[:-1]
    same[bound[:-1][bound[:-1] < len(h)]] = 0
    bound64 = bound.astype(np.int64)
    length = np.concatenate([[0], np.cumsum(end - start)])
    x = np.stack(
        [
            np.log1p(np.diff(bound)), _count(mark, off) / n, _count(upper, off) / size, _count(digit, off) / size, _count(space, off) / size,
            _count(same, bound64) / n, (length[bound[1:]] - length[bound[:-1]]) / n,
        ],
        axis=1,
    )
    if not len(known):
        return x, (np.empty(0, np.int64), np.empty(0, np.int64))
    owner, sign = _signs(data, h, bound, start, end)
    there = np.zeros(1 << 16, bool)
    there[(known >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(there[(sign >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, sign[maybe]), len(known) - 1)
    hit = known[at] == sign[maybe]
    return x, _distinct(owner[maybe[hit]], at[hit])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    clean = ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    few = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(clean).alias("clean"))
    few = few.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    # at most SAMPLE rows of two numbers; of rows with one id the least text is taken, so that as many documents come out
    labelled = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(few), "_id")
    return labelled.groupBy("_id").agg(F.min("text").alias("text"), F.first("clean").alias("clean")).select("text", "clean")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    with interim(docs.sparkSession):
        return _fitted(written(_sample(docs, labels, id_col, text_col), "sample"))


def _fitted(sample: DataFrame) -> Model:
    total = {r["clean"]: r["n"] for r in sample.groupBy("clean").agg(F.count("*").alias("n")).collect()}
    good, bad = total.get(1, 0), total.get(0, 0)
    if not good or not bad:
        return Model(np.empty(0, np.uint64), np.zeros(_MEASURES), np.zeros(_MEASURES), np.ones(_MEASURES), 0.0)

    def presence(batches):
        for b in batches:
            clean = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in texts(b.column(0), 4 * PIECE):
                owner, word = _distinct(*_signs(data, *words(data, off, with_bytes=True)))
                value, at = np.unique(word, return_inverse=True)
                g = np.bincount(at, weights=clean[lo:hi][owner], minlength=len(value)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(g), pa.array(np.bincount(at, minlength=len(value)) - g)], ["word", "good", "bad"])

    tally = sample.mapInArrow(presence, "word long, good long, bad long").groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    pooled = (F.col("good") + F.col("bad") + 1) / (good + bad + 2)
    z = F.abs(F.col("good") / good - F.col("bad") / bad) / F.sqrt(pooled * (1 - pooled) * (1 / good + 1 / bad))
    chosen = tally.where(F.col("good") + F.col("bad") >= LEAST_DOCUMENTS).where(z >= STANDARD_ERRORS).orderBy(z.desc(), "word").limit(VOCABULARY).select("word").collect()
    known = np.sort(np.array([r[0] for r in chosen], np.int64).view(np.uint64))

    def measure(batches):
        for b in batches:
            clean = b.column(1)
            for lo, hi, data, off in texts(b.column(0), 4 * PIECE):
                x, (owner, at) = features(data, off, known)
                there = np.zeros((hi - lo, len(known)), np.uint8)
                there[owner, at] = 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in there], pa.binary()), clean.slice(lo, hi - lo)], ["x", "w", "clean"]
                )

    rows = sample.mapInArrow(measure, "x binary, w binary, clean int").toArrow()  # SAMPLE rows of a few hundred bytes
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), float).reshape(-1, _MEASURES)
    w = np.frombuffer(b"".join(rows.column("w").to_pylist()), np.uint8).reshape(len(x), len(known))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    full = np.concatenate([(x - mean) / scale, w, np.ones((len(x), 1))], axis=1)
    weight = _newton(full, rows.column("clean").to_numpy().astype(float))
    return Model(known, weight[:-1], mean, scale, float(weight[-1]))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with a ridge penalty on all but the last weight."""
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = lambda w: np.sum(np.logaddexp(0, x @ w) - y * (x @ w)) + 0.5 * np.sum(penalty * w * w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        t, now = 1.0, loss(w)
        while loss(w + t * step) > now and t > 1e-4:
            t /= 2
        w = w + t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return w


def _evidence(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` and a column ``_logit``, the evidence of ``_text`` alone."""
    at = rows.columns.index("_text")

    def score(batches):
        for b in batches:
            for lo, hi, data, off in texts(b.column(at), 4 * PIECE):
                z = np.clip(model.logit(data, off), -30, 30)
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(z)], [*b.schema.names, "_logit"])

    return rows.mapInArrow(score, T.StructType([*rows.schema, T.StructField("_logit", T.DoubleType())]))


def _strength(group: DataFrame, mean: float) -> float:
    """Prior weight, in documents, from the spread of the groups' shares (columns n, s, q: count, sum, sum of squares)."""
    share = F.col("s") / F.col("n")
    r = group.agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count("*"), F.sum(F.col("n") * (share - mean) ** 2), F.sum(F.col("q") - F.col("n") * share * share)).first()
    n, square, groups, between, within = (float(v or 0) for v in r)
    if groups < 2 or n <= groups:
        return 100.0
    noise = within / (n - groups)
    spread = (between - (groups - 1) * noise) / max(n - square / n, 1e-9)
    return min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1.0), 1e6)


def site_shares(evidence: DataFrame) -> tuple[DataFrame, float, float]:
    """Per (host, path): count, sum of evidence and the host's shrunk share; the path prior's weight; the corpus share."""
    p = (1 / (1 + F.exp(-F.col("_logit")))).alias("p")
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    path = written(evidence.select("_host", "_path", p).groupBy("_host", "_path").agg(*sums), "paths")
    n, s = path.agg(F.sum("n"), F.sum("s")).first()
    mean = min(max((s or 0.0) / n, 1e-3), 1 - 1e-3) if n else 0.5
    host = path.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    of_host, of_path = _strength(host, mean), _strength(path, mean)
    shrunk = host.select(F.col("_host").alias("_h"), ((F.col("s") + of_host * mean) / (F.col("n") + of_host)).alias("host_share"))
    sites = path.join(shrunk, F.col("_host").eqNullSafe(F.col("_h")))
    return sites.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "n", "s", "host_share"), of_path, mean


def _judged(docs: DataFrame, model: Model, host_col: str, path_col: str, text_col: str, only_kept: bool) -> tuple[DataFrame, dict[str, str]]:
    """The text is scored twice, once for the sites' sums and once for the rows: that costs less than carrying it through a shuffle."""
    own = {"_host": host_col, "_path": path_col, "_text": text_col}
    with interim(docs.sparkSession) as keep:
        sites, strength, mean = site_shares(_evidence(packed(docs, **own).drop("_row"), model))
        sites = keep(written(sites, "sites"))
    if sites.count() <= _BROADCAST_SITES:  # else the texts are shuffled by site and skewed sites are split
        sites = F.broadcast(sites)
    rows = _evidence(packed(docs, **own), model)
    rows = rows.join(sites, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
    p = 1 / (1 + F.exp(-F.col("_logit")))
    share = (F.greatest(F.col("s") - p, F.lit(0.0)) + strength * F.col("host_share")) / (F.col("n") - 1 + strength)
    share = F.least(F.greatest(share, F.lit(1e-3)), F.lit(1 - 1e-3))
    z = F.col("_logit") + F.log(F.col("site_share") / (1 - F.col("site_share"))) - math.log(mean / (1 - mean))
    rows = rows.withColumns({"evidence": p, "site_share": share}).withColumn("score", 1 / (1 + F.exp(-z))).withColumn("keep", F.col("score") >= 0.5)
    return rows.where("keep") if only_kept else rows, own


def judged(docs: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` with ``evidence``, ``site_share``, ``score`` (probability of being clean) and ``keep``; these replace columns of the same name."""
    rows, own = _judged(docs, model, host_col, path_col, text_col, False)
    return unpacked(rows, docs, own, "evidence", "site_share", "score", "keep")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The document rows, with their own columns, that the classifier fitted on ``labels`` doesn't reject."""
    rows, own = _judged(docs, fit(docs, labels, id_col, text_col), host_col, path_col, text_col, True)
    return unpacked(rows, docs, own)
