"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is its set of k-word shingles.  Its signature is a pool of MinHash digits (one byte
each), and every tree of the forest draws a sequence of twelve of them, packed into two integers,
so that the sorted integers of a tree are its prefix trie: the texts that share the first d digits
are one node of depth d.

Search.  Only nodes of the shortest depth that hold two texts are opened; below them the size of
every node on a text's path is counted.  A text then shortens its matched prefixes: with a growing
bound on the size of nodes it takes in each tree the shortest prefix whose node is within the
bound, until a partner at the threshold is met in some tree with the target recall.  A text that
nobody resembles so stops at once, one in a crowd of weak resemblance stays at long prefixes and
takes its recall from the trees where the crowd is thin.

Nodes.  In each node the texts' signatures are compared, and only a pair whose digits agree as
often as a pair at the threshold does, but for ``SIGMAS`` deviations, ties its texts together.
A node yields a spanning forest of such ties, never its pairs: what is tied to a visited text
leaves the search, so a node of near copies costs its size, not its square.  A node of more than
``NODE_ROWS`` texts is dealt into blocks and each pair of blocks is a task.

Verification.  The components of the ties are verified exactly: each is dealt into blocks of
bounded size, and every pair of blocks is one task that counts the common shingles of all its
pairs.  Only counts and labels leave the task.  Classes are the components of verified links.

Copies (equal word sequences) are one text throughout and are counted, not expanded.

Defined results: a text of fewer than k words, but not none, has its whole word sequence as its
one shingle; a text without words (null, empty, only punctuation) has no links and a class of its
own; a null id has a null class and no links; ids may be of any type that has an order; rows with
equal ids count one by one, and each reports its own text's class; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.llm.common import PIECE, grams, interim, mix, packed, quoted, spread, texts, unpacked, words, written
from concordia.llm.components import components

#: Texts, and shingles of them, that a verification task holds of each of its two blocks, about.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19
#: Texts of one node that a task compares in each of its two blocks; a row is under 200 bytes.
NODE_ROWS = 1 << 16
#: Depths at which nodes are counted; the first is the shortest prefix, the last the whole sequence.
LEVELS = (6, 7, 8, 10, 12)
#: Digits of a signature, and how many of them a node compares.
POOL, COMPARED = 240, 120
#: A tie may fall short of the threshold by so many standard deviations of the share of agreeing digits.
SIGMAS = 4.5
_SMALL = 16
_NOBODY = 1 << 62


def shingles(h: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts one after another (repeats stay), and how many each text has."""
    size = np.diff(bound)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    owner, rank = spread(count)
    at = bound[:-1][owner] + rank
    g = grams(h, k)
    out = np.zeros(len(at), np.uint64)
    whole = size[owner] >= k
    out[whole] = g[at[whole]]
    for i in np.flatnonzero((size > 0) & (size < k)).tolist():
        out[np.searchsorted(owner, i)] = _sequence(h[bound[i] : bound[i + 1]], 7)
    return out, count


def _sequence(h: np.ndarray, seed: int) -> np.uint64:
    """One hash of a word sequence."""
    weight = mix(np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(2 * seed + 1))
    return mix(np.array([np.sum(mix(h + weight), dtype=np.uint64) + np.uint64(len(h))], np.uint64))[0]


def _sequences(h: np.ndarray, bound: np.ndarray, seed: int) -> np.ndarray:
    """Of each text: the hash of its word sequence (0 without words)."""
    size = np.diff(bound)
    _, rank = spread(size)
    weight = mix((rank + 1).astype(np.uint64) * np.uint64(2 * seed + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + weight), dtype=np.uint64)])
    out = total[bound[1:]] - total[bound[:-1]] + size.astype(np.uint64)
    return np.where(size > 0, mix(out), np.uint64(0))


def _fixed(rows: list[bytes] | np.ndarray, width: int) -> pa.Array:
    """A binary column of values of one width from their bytes one after another."""
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a binary column of values of one width, a row for each."""
    if not len(column):
        return np.empty((0, width), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def text_names(h: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Of each text: 16 bytes that stand for its word sequence."""
    return np.stack([_sequences(h, bound, 1), _sequences(h, bound, 2)], axis=1).view(np.uint8).reshape(-1, 16)


class Forest:
    """MinHash functions of the pool, and the sequences that the trees draw from it."""

    def __init__(self, trees: int = 40, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        draw = rng.integers(0, 1 << 32, (3, POOL), dtype=np.uint64).astype(np.uint32)
        self.flip, self.times, self.again = draw[0], draw[1] | 1, draw[2] | 1
        need = trees * LEVELS[-1]
        self.order = np.concatenate([rng.permutation(POOL) for _ in range(-(-need // POOL))])[:need].reshape(trees, LEVELS[-1])
        self.trees = trees

    def digits(self, g: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Signatures of the texts, which all have shingles: a row of ``POOL`` bytes for each."""
        start = np.cumsum(count) - count
        x = (g >> np.uint64(32)).astype(np.uint32)
        y, z = np.empty_like(x), np.empty_like(x)
        out = np.empty((len(count), POOL), np.uint8)
        for j in range(POOL):
            np.bitwise_xor(x, self.flip[j], out=y)
            y *= self.times[j]
            np.right_shift(y, 16, out=z)
            y ^= z
            y *= self.again[j]
            out[:, j] = np.minimum.reduceat(y, start) * np.uint32(0x9E3779B1) >> np.uint32(24)
        return out

    def sequences(self, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and tree: the tree's number with the first six digits, and the last six."""
        s = digits[:, self.order].astype(np.int64)
        key = np.broadcast_to(np.arange(self.trees), s.shape[:2]).copy()
        deep = np.zeros(s.shape[:2], np.int64)
        for d in range(6):
            key = (key << 8) | s[:, :, d]
            deep = (deep << 8) | s[:, :, 6 + d]
        return key, deep


def _signatures(docs: DataFrame, id_col: str, text_col: str, forest: Forest, k: int) -> DataFrame:
    def sign(batches):
        for b in batches:
            for lo, hi, data, off in texts(b.column(2), 2 * PIECE):
                h, bound = words(data, off)
                g, count = shingles(h, bound, k)
                some = count > 0
                digits = np.zeros((hi - lo, POOL), np.uint8)
                if some.any():
                    digits[some] = forest.digits(g, count[some])
                name = text_names(h, bound)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), _fixed(name, 16), pa.array(name.view(np.int64)[:, 0]), pa.array(count.astype(np.int64)), _fixed(digits, POOL)],
                    ["id", "th", "name", "h1", "size", "digits"],
                )

    text = F.col(quoted(text_col)).cast("string")
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    own = [rows.schema["id"], *(T.StructField(n, t) for n, t in (("th", T.LongType()), ("name", T.BinaryType()), ("h1", T.LongType()), ("size", T.LongType()), ("digits", T.BinaryType())))]
    return rows.mapInArrow(sign, T.StructType(own))


def _paths(classes: DataFrame, forest: Forest) -> DataFrame:
    """``(h1, key, deep)``: every text's sequence in every tree."""

    def walk(batches):
        for b in batches:
            h1 = b.column(0).to_numpy()
            for lo in range(0, len(h1), 2048):
                key, deep = forest.sequences(_matrix(b.column(1).slice(lo, 2048), POOL))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h1[lo : lo + 2048], forest.trees)), pa.array(key.ravel()), pa.array(deep.ravel())], ["h1", "key", "deep"])

    return classes.select("h1", "digits").mapInArrow(walk, "h1 long, key long, deep long")


def _met(threshold: float, depth: int) -> float:
    """Logarithm of the chance that a pair at the threshold shares no node of this depth in one tree."""
    return math.log1p(-(threshold**depth))


def _open_nodes(places: DataFrame, threshold: float, recall: float, trees: int) -> DataFrame:
    """``(node, m)`` of the nodes that some text's prefixes are shortened to.

    ``places`` has a row for each (text, tree, depth) whose node holds m > 1 texts.
    """
    goal = math.log1p(-recall)
    path = places.groupBy("h1", "tree").agg(F.sort_array(F.collect_list(F.struct("depth", "m", "node"))).alias("path"))  # one element a depth at most
    path = written(path, "path")
    next_depth = F.array(*[F.lit(d) for d in LEVELS])
    within = lambda bound: F.get(F.filter("path", lambda x: x["m"] <= bound), 0)
    chance = F.create_map(*[F.lit(x) for d in LEVELS for x in (d, _met(threshold, d))])
    alone = _met(threshold, LEVELS[0])
    bounds = [4**i for i in range(1, 13)]
    depth = lambda bound: F.coalesce(within(F.lit(bound))["depth"], F.get(next_depth, F.size("path")))
    loss = [F.sum(F.coalesce(F.element_at(chance, depth(b)), F.lit(0.0))).alias(f"loss{i}") for i, b in enumerate(bounds)]
    text = path.groupBy("h1").agg(((trees - F.count("*")) * alone).alias("rest"), *loss)
    bound = F.coalesce(*[F.when(F.col(f"loss{i}") + F.col("rest") <= goal, F.lit(b).cast("long")) for i, b in enumerate(bounds)], F.lit(_NOBODY))
    chosen = path.join(text.select("h1", bound.alias("bound")), "h1").select(within(F.col("bound")).alias("x"))
    return chosen.where("x IS NOT NULL").select("x.node", "x.m").distinct()


def spanning_ties(group: np.ndarray, digits: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs that tie rows of one group which agree in ``need`` digits, as a spanning forest, and how many pairs were compared.

    ``group`` is sorted.
    """
    n, compared, a, b = len(group), 0, [], []
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, np.int64)
    size = np.diff(np.append(start, n))
    label = np.arange(n)
    small = np.repeat(size <= _SMALL, size)
    for k in range(1, min(_SMALL, int(size.max(initial=0)))):
        at = np.flatnonzero((group[:-k] == group[k:]) & small[k:])
        compared += len(at)
        at = at[(digits[at] == digits[at + k]).sum(axis=1) >= need]
        a.append(at)
        b.append(at + k)
    if a:
        p, q = np.concatenate(a), np.concatenate(b)
        while True:
            low, new = np.minimum(label[p], label[q]), label.copy()
            np.minimum.at(new, p, low)
            np.minimum.at(new, q, low)
            if np.array_equal(new, label):
                break
            label = new
    tied = np.flatnonzero(label != np.arange(n))
    left, right = [label[tied]], [tied]
    for s, m in zip(start[size > _SMALL].tolist(), size[size > _SMALL].tolist(), strict=True):
        there, at = np.arange(s, s + m), digits[s : s + m]
        while len(there):
            stack, there, at = [there[0]], there[1:], at[1:]
            while stack and len(there):
                u = stack.pop()
                compared += len(there)
                near = (at == digits[u]).sum(axis=1) >= need
                if near.any():
                    hit = there[near]
                    left.append(np.full(len(hit), u))
                    right.append(hit)
                    stack += hit.tolist()
                    there, at = there[~near], at[~near]
    return np.concatenate(left), np.concatenate(right), compared


def _ties(members: DataFrame, need: int, counter) -> DataFrame:
    """``(a, b)`` of texts tied in some node; ``members`` (grp, h1, digits) comes sorted by grp within its partitions."""

    def tie(batches):
        def done(parts):
            h1 = np.concatenate([p[1] for p in parts])
            a, b, compared = spanning_ties(np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]), need)
            if counter is not None:
                counter.add(compared)
            return pa.RecordBatch.from_arrays([pa.array(h1[a]), pa.array(h1[b])], ["a", "b"])

        held = []  # the rows of a group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, h1, digits = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), COMPARED)
            last = int(np.searchsorted(grp, grp[-1]))
            if last or (held and held[-1][0][-1] != grp[0]):
                yield done([*held, (grp[:last], h1[:last], digits[:last])])
                held = []
            held.append((grp[last:], h1[last:], digits[last:]))
        if held:
            yield done(held)

    return members.mapInArrow(tie, "a long, b long")


def candidate_ties(classes: DataFrame, forest: Forest, threshold: float, recall: float, counter=None) -> DataFrame:
    """``(a, b)``: links of texts (by ``h1``) that the forest brings together and whose signatures nearly reach the threshold."""
    paths = _paths(classes, forest)
    # written, so that the joins below are between two shuffles and a node with very many texts can be split
    shared = written(paths.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "shared")
    together = written(paths.join(shared, "key", "left_semi"), "together")
    node = lambda d: F.struct(F.lit(d).alias("depth"), F.xxhash64("key", F.lit(d), F.shiftright("deep", 8 * (LEVELS[-1] - d))).alias("node"))
    places = together.select("h1", F.shiftright("key", 48).cast("int").alias("tree"), F.explode(F.array(*[node(d) for d in LEVELS])).alias("x")).select("h1", "tree", "x.*")
    sizes = written(places.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    places = written(places.join(sizes, "node"), "places")
    open_ = written(_open_nodes(places, threshold, recall, forest.trees), "open")
    blocks = F.ceil(F.col("m") / NODE_ROWS).cast("int")
    here = F.pmod(F.xxhash64("h1"), blocks).cast("int")
    others = F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: j != here))
    members = places.select("node", "h1").join(open_, "node").select("node", "h1", here.alias("i"), F.explode(others).alias("j"))
    members = members.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("grp"), "h1")
    members = members.join(classes.select("h1", F.substring("digits", 1, COMPARED).alias("digits")), "h1").select("grp", "h1", "digits")
    need = math.ceil(COMPARED * threshold - SIGMAS * math.sqrt(COMPARED * threshold * (1 - threshold)))
    ties = written(_ties(members.repartition("grp").sortWithinPartitions("grp"), need, counter).where("a <> b").distinct(), "ties")
    return ties


def common_counts(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """How many elements sets[rows[i]] and sets[cols[j]] share, from bitmaps over slices of the shared elements."""
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    value, place, df = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(df > 1) - 1
    shared = df[place] > 1
    owner, bit = np.repeat(np.arange(len(sets)), size)[shared], number[place[shared]]
    out = np.zeros((len(rows), len(cols)), np.int32)
    step = 1 << 14
    order = np.argsort(bit, kind="stable")
    owner, bit = owner[order], bit[order]
    for lo in range(0, int(bit[-1]) + 1 if len(bit) else 0, step):
        a, z = np.searchsorted(bit, [lo, lo + step])
        width = min(step, int(bit[-1]) + 1 - lo)
        flat = np.zeros((len(sets), (width + 63) // 64 * 64), np.uint8)
        flat[owner[a:z], bit[a:z] - lo] = 1
        maps = np.packbits(flat, axis=1).view(np.uint64)
        left, right = maps[rows], maps[cols]
        for i in np.flatnonzero(left.any(axis=1)).tolist():
            out[i] += np.bitwise_count(right & left[i]).sum(axis=1, dtype=np.int32)
    return out


def _verify(k: int, threshold: float):
    """A task of two blocks (or one with itself): per text its links' weight here and the least name it is linked to."""

    def verify(key, table):
        bi, bj = key[1].as_py(), key[2].as_py()
        table = table.combine_chunks()
        sets, seen = [], set()
        want, weight, block = (table.column(c).to_pylist() for c in ("name", "n", "block"))
        for lo, hi, data, off in texts(table.column("text"), 2 * PIECE):
            h, bound = words(data, off)
            g, count = shingles(h, bound, k)
            name, ends = text_names(h, bound), np.concatenate([[0], np.cumsum(count)])
            for i in range(hi - lo):
                r = lo + i
                if want[r] not in seen and name[i].tobytes() == want[r]:  # repeated rows hold a text twice
                    seen.add(want[r])
                    sets.append((want[r], weight[r], block[r], np.unique(g[ends[i] : ends[i + 1]])))
        sets.sort(key=lambda s: s[0])
        w, at = np.array([s[1] for s in sets], np.int64), np.array([s[2] for s in sets])
        size = np.array([len(s[3]) for s in sets], np.int64)
        rows, cols = np.flatnonzero(at == bi), np.flatnonzero(at == bj)
        common = common_counts([s[3] for s in sets], rows, cols)
        linked = common >= threshold * (size[rows][:, None] + size[cols] - common) - 1e-9
        links = np.zeros(len(sets), np.int64)
        if bi == bj:
            np.fill_diagonal(linked, False)
            links[rows] = linked @ w[cols]
        else:
            links[rows] += linked @ w[cols]
            links[cols] += w[rows] @ linked
        label = np.arange(len(sets))
        a, b = np.nonzero(linked)
        a, b = rows[a], cols[b]
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            if np.array_equal(new, label):
                break
            label = new
        return pa.table({"name": pa.array([s[0] for s in sets], pa.binary()), "links": pa.array(links), "label": pa.array([sets[i][0] for i in label.tolist()], pa.binary())})

    return verify


def _classed(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, recall: float, trees: int, counter=None) -> DataFrame:
    """``(id, th, class_id, n_links)`` of every row; th is the hash of its text."""
    forest = Forest(trees)
    with interim(docs.sparkSession) as keep:
        signed = keep(written(_signatures(docs, id_col, text_col, forest, k), "signed"))
        firsts = [F.first(c).alias(c) for c in ("h1", "size", "digits")]
        classes = written(signed.where("size > 0 AND id IS NOT NULL").groupBy("name").agg(F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("n"), *firsts), "classes")
        ties = candidate_ties(classes, forest, threshold, recall, counter)
        tied = components(ties, "a", "b")
        tied = tied.union(tied.select(F.col("root").alias("node"), "root").distinct())
        members = classes.drop("digits").join(tied, F.col("h1") == F.col("node")).select("name", "rep", "n", "size", "root")
        sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        dealt = written(members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")), "dealt")
        many = (dealt.agg(F.max("blocks")).first()[0] or 0) > 1
        pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        text = F.col(quoted(text_col)).cast("string")
        text = docs.select(F.struct(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("th")).alias("rep"), text.alias("text"))
        # the text is shuffled once at every size; a broadcast of the classes would grow with the corpus
        tasks = text.join(dealt.hint("shuffle_hash"), "rep").select("*", pair.alias("other"))
        tasks = tasks.select("root", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "name", "n", "block", "text")
        checked = written(tasks.groupBy("root", "bi", "bj").applyInArrow(_verify(k, threshold), "name binary, links long, label binary"), "checked")
        if many:  # a class may run over several tasks
            label = components(checked.select("name", "label"), "name", "label").select(F.col("node").alias("name"), F.col("root").alias("label"))
        else:
            label = checked.select("name", "label")
        found = checked.groupBy("name").agg(F.sum("links").alias("links")).join(label, "name", "left")
        found = found.select("name", "links", F.coalesce("label", "name").alias("label")).join(classes.select("name", "rep.id"), "name")
        found = written(found, "found")
        least = written(found.groupBy("label").agg(F.min("id").alias("class_id")), "least")
        found = found.join(least, "label").select("name", "links", "class_id")
        of_class = classes.select("name", "rep", "n").join(found, "name", "left")
        of_class = of_class.select("name", F.coalesce("class_id", "rep.id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
        of_class = keep(written(of_class, "of_class"))  # so that the join is between two shuffles and a text with very many copies can be split
    rows = signed.select("id", "th", "name").join(of_class, "name", "left")
    known = F.col("id").isNotNull()
    return rows.select("id", "th", F.when(known, F.coalesce("class_id", "id")).alias("class_id"), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.9995, trees: int = 40, counter=None) -> DataFrame:
    """One row per document row: ``(id, class_id, n_links)``.

    ``class_id`` is the least id of the documents joined by links of at least ``threshold``;
    ``n_links`` is the number of documents linked to this one, its copies included.  An accumulator
    given as ``counter`` gets the number of signatures that were compared.
    """
    return _classed(docs, id_col, text_col, k, threshold, recall, trees, counter).select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.9995, trees: int = 40) -> DataFrame:
    """The document rows without the near copies: of each class its least id stays (and rows without an id)."""
    found = _classed(docs, id_col, text_col, k, threshold, recall, trees)
    gone = found.where(F.col("class_id") < F.col("id")).select(F.col("id").alias("_gone"), F.col("th").alias("_gone_text")).distinct()
    own = {"_key": id_col, "_text": text_col}
    rows = packed(docs, **own)
    same = (F.col("_key") == F.col("_gone")) & (F.xxhash64(F.col("_text").cast("string")) == F.col("_gone_text"))
    return unpacked(rows.join(gone, same, "left_anti"), docs, own)
