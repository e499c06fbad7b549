"""Operators over whole corpora, each against a brute-force version on a small table."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.llm import common, decontaminate, lines, mixing, neardup, quality, topk
from concordia.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ------------------------------------------------------------------ kernels


def test_words_of_byte_buffers_equal_the_pattern():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [None, "", "Ab cD_éÉ9", "a" * 70 + "-" + "ß" * 30, *["".join(rng.choice("aB1 -é\n😀.") for _ in range(rng.randrange(200))) for _ in range(60)]]
    texts += ["x y " * 400_000, "z" * 3_000_000]  # longer than one piece
    seen = {}
    for lo, hi, data, off in common.texts(pa.array(texts), 1 << 20):
        h, bound = common.words(data, off)
        for i in range(hi - lo):
            own, want = h[bound[i] : bound[i + 1]].tolist(), words(texts[lo + i])
            assert len(own) == len(want)
            for a, w in zip(own, want, strict=True):
                assert seen.setdefault(w, a) == a
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in list(parent) if root(x) != x}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 1 line dedup


def edit_at_most_one(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_line_dedup(rows):
    every = [(d, n, x) for d, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    out = {}
    for d, n, x in every:
        if x.strip(" ") and any((e, m) < (d, n) and (x == y or len(x) >= lines.SHORTEST and len(y) >= lines.SHORTEST and edit_at_most_one(x, y)) for e, m, y in every):
            continue
        out.setdefault(d, []).append(x)
    return {d: None if t is None else "\n".join(out.get(d, [])) for d, t in rows}


def test_every_near_line_is_among_the_variants(spark):
    """Of all lines of a test table: those with an earlier one within one edit are those that a common variant shows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = lines._lines(docs, "doc_id", "text").groupBy("h1", "h2", "line").agg(F.min(F.struct("id", "no")).alias("at"))
    candidates = rows.select("h1", "h2", F.length("line").cast("int").alias("n"), "at", "line").where(F.col("n") >= lines.SHORTEST).persist()
    every = {r.line: tuple(r["at"]) for r in candidates.collect()}
    by_size: dict = {}
    for x in every:
        by_size.setdefault(len(x), []).append(x)
    near = {x for x in every for m in (len(x) - 1, len(x), len(x) + 1) for y in by_size.get(m, ()) if every[y] < every[x] and edit_at_most_one(x, y)}
    variants = lines._variant_rows(candidates)
    shared = variants.groupBy("key").agg(F.count_distinct("me.h1").alias("m"), F.collect_set("me.h1").alias("of")).where("m > 1")
    hit = {r.h1 for r in shared.select(F.explode("of").alias("h1")).distinct().collect()}
    h1 = {r.line: r.h1 for r in candidates.select("line", "h1").collect()}
    assert near and {h1[x] for x in near} <= hit
    assert variants.count() > len(near)
    assert {r.h1 for r in lines._near_one(candidates).collect()} == {h1[x] for x in near}


def test_lines_against_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé 1") for _ in range(n)) for n in (3, 9, 15, 16, 17, 31, 32, 33, 47, 48, 49, 64, 65, 90, 160, 161)]

    def near(x):
        i, k = rng.randrange(len(x)), rng.randrange(5)
        return [x, x[:i] + "z" + x[i + 1 :], x[:i] + x[i + 1 :], x[:i] + "q" + x[i:], x[:i] + "qq" + x[i:]][k]

    rows = [(d, "\n".join(rng.choice([near(rng.choice(base)), rng.choice(base), "", "  ", sentence(rng, 6)]) for _ in range(rng.randrange(1, 9)))) for d in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "a" * 50_000), (1004, "a" * 49_999), (1005, "b" + "a" * 50_000 + "\nb")]
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, at string, `drop` int")
    got = lines.dedup_lines(df, counts=True)
    assert got.columns == ["doc_id", "text", "at", "drop", "n_lines", "n_dropped"]
    found = {r.doc_id: r for r in got.collect()}
    assert {d: r.text for d, r in found.items()} == plain_line_dedup(rows)
    assert found[1000].n_lines == 0 and found[1005].n_dropped == 1 and found[3].drop == 5


def test_lines_of_odd_tables(spark):
    assert lines.dedup_lines(spark.createDataFrame([], DOC)).count() == 0
    df = spark.createDataFrame([(None, "the very same line"), (1, "the very same line"), (1, "the very same line")], "doc_id long, text string")
    assert sorted((r.doc_id is not None, r.text) for r in lines.dedup_lines(df).collect()) == [(False, "the very same line"), (True, ""), (True, "")]


def edit_at_most(a, b, k):
    if a == b:
        return True
    if not k or abs(len(a) - len(b)) > k:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    return edit_at_most(a[1:], b[1:], k - 1) or edit_at_most(a[1:], b, k - 1) or edit_at_most(a, b[1:], k - 1)


@pytest.mark.parametrize("few", [0, 5])
def test_lines_two_edits_apart_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(lines, "FEW", few)  # 0: all by halving and variants
    rng = random.Random(40)
    base = ["".join(rng.choice("ab 1") for _ in range(n)) for n in (15, 16, 17, 18, 31, 32, 33, 34, 47, 48, 49, 65, 130, 161)]

    def near(x):
        for _ in range(rng.randrange(4)):
            i, k = rng.randrange(len(x) + 1), rng.randrange(3)
            x = [x[:i] + "z" + x[i + 1 :], x[:i] + x[i + 1 :], x[:i] + "q" + x[i:]][k]
        return x

    texts = ["\n".join(near(rng.choice(base)) for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    texts += ["una linea de ta casa en la calle larga", "una linea de su casa en la calle larga", "una linea de su casa en la caIIe larga"]
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), edits=2).collect()
    every = [(d, n, x) for d, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    kept = {}
    for d, n, x in every:
        if not any((e, m) < (d, n) and (x == y or min(len(x), len(y)) >= lines.SHORTEST and edit_at_most(x, y, 2)) for e, m, y in every):
            kept.setdefault(d, []).append(x)
    assert {r.doc_id: r.text for r in got} == {d: "\n".join(kept.get(d, [])) for d in range(len(texts))}
    assert [r.text for r in sorted(got)[-3:]] == [texts[-3], "", ""]


@pytest.mark.parametrize("edits", [1, 2])
def test_short_lines_when_asked_for(spark, edits):
    rng = random.Random(41)
    texts = ["\n".join("".join(rng.choice("ab") for _ in range(rng.randrange(3, 20))) for _ in range(3)) for _ in range(50)]
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), edits=edits, shortest=6).collect()
    every = [(d, n, x) for d, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    kept = {}
    for d, n, x in every:
        if not any((e, m) < (d, n) and (x == y or min(len(x), len(y)) >= 6 and edit_at_most(x, y, edits)) for e, m, y in every):
            kept.setdefault(d, []).append(x)
    assert {r.doc_id: r.text for r in got} == {d: "\n".join(kept.get(d, [])) for d in range(len(texts))}


def test_a_text_of_very_many_lines(spark):
    n = 60_000
    df = spark.createDataFrame([(1, "a line of its own\n" + "the same line again\n" * n), (None, "the same line again\nx"), (None, "y\nthe same line again")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_lines, r.text, r.n_dropped) for r in lines.dedup_lines(df, counts=True).collect())
    assert got == [(0, 2, "the same line again\nx", 0), (0, 2, "y", 1), (1, n + 2, "a line of its own\n", n)]


# ------------------------------------------------------------------ 2 mixing


def plain_targets(size, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted([s for s in size if s is not None]) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(size.values()), {}
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return full
        level = (total - sum(full.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * size[s]]
        if not over:
            return full | {s: level * weight[s] for s in free}
        full |= {s: cap * size[s] for s in over}


def test_mix_meets_every_target(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, min(int(rng.paretovariate(1.1) * 20), 3000)), rng.choice(["hot"] * 6 + ["a", "b", "é", None, "Z"])) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", "void"), (2002, None, "void"), (3, "again", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.balanced_mix(df).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = plain_targets(size)
    taken = {}
    for r in got:
        n = len((r.text or "").split())
        assert r.size == n and r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * n and r.taken == r.copies * n
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 5, (s, taken[s], want[s])
    key = lambda rs: sorted((r.doc_id, r.text or "", r.copies) for r in rs)
    assert key(mixing.balanced_mix(df.repartition(7)).collect()) == key(got)
    out = mixing.take(df).groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.max("copies").alias("c"), F.max("copy").alias("m")).collect()
    assert all(r.n == r.c == r.m for r in out if r.doc_id != 3)
    assert mixing.balanced_mix(df.limit(0)).count() == 0


def mixed(spark, rows, **how):
    return mixing.balanced_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), **how).collect()


def off_target(got):
    """Of each source: how many words its taken words are from its target, and its largest document."""
    out = {}
    for r in got:
        taken, target, largest = out.get(r.source, (0, r.target, 0))
        out[r.source] = (taken + r.taken, target, max(largest, r.size))
    return {s: (abs(taken - target), largest) for s, (taken, target, largest) in out.items()}


def test_mix_of_repeated_rows_and_rows_without_ids(spark):
    same = "one two three four five six seven"
    rows = [(i, " ".join(["a"] * (20 + i % 60)), "a") for i in range(1000)] + [(None, " ".join([f"n{i}"] * 50), "b") for i in range(600)] + [(i, " ".join(["b"] * 50), "b") for i in range(400)]
    rows += [(5, same, "c")] * 300 + [(None, same, "c")] * 100 + [(i, same, "c") for i in range(10_000, 10_050)] + [(7, same, None)] * 200
    got = mixed(spark, rows)
    assert len(got) == len(rows) and all(off <= largest for off, largest in off_target(got).values()), off_target(got)
    again = mixing.balanced_mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5, "text")).collect()
    key = lambda rs: sorted((str(r.doc_id), r.text, str(r.source), r.copies) for r in rs)
    assert key(again) == key(got)


@pytest.mark.parametrize("tail", ["wide", "heavy", "few"])
def test_rates_equal_a_plain_solver(spark, tail):
    rng = random.Random(21)
    draw = {"wide": lambda: int(rng.lognormvariate(4, 2)) + 1, "heavy": lambda: min(int(rng.paretovariate(0.7)), 40_000), "few": lambda: 10}[tail]
    rows = [(i, "w " * draw(), "ab"[i % 2]) for i in range(600)] + ([(9000 + i, "w " * 20_000, "a") for i in range(5)] if tail == "few" else [])
    got = mixed(spark, rows)
    assert all(off <= largest for off, largest in off_target(got).values())
    for s in "ab":
        size, target = np.array([r.size for r in got if r.source == s], float), next(r.target for r in got if r.source == s)
        rates = lambda a: np.minimum(2, np.exp(np.minimum(a * size / size.mean(), 50)))  # noqa: B023, E731
        low, high = -1e6, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (rates(mid) * size).sum() < target else (low, mid)
        assert np.allclose([r.rate for r in got if r.source == s], rates(high), rtol=1e-4, atol=1e-6)


def test_targets_equal_their_sql(spark):
    import duckdb

    from concordia.llm.queries import OP2_TARGETS, op2_balanced_mix
    from tests.compare import DATA

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(OP2_TARGETS).fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.target) for r in op2_balanced_mix(spark, DATA).collect()}
    assert got.keys() == want.keys() and all(got[d][:2] == want[d][:2] and got[d][2] == pytest.approx(want[d][2]) for d in got)


# ------------------------------------------------------------------ 5 quality


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(7)

    def doc(i):
        kind = i % 10
        t = sentence(rng, rng.randrange(30, 200))
        if kind == 0:
            t = " ".join(w + rng.choice(["###", "***"]) for w in t.split())
        if kind == 1:
            t += " " + " ".join(rng.choice(["idiot", "scum", "moron"]) for _ in range(6))
        return (i, t, "en", f"s{i % 4}", len(t), int(kind != 0), int(kind == 1))

    rows = [doc(i) for i in range(900)]
    df = spark.createDataFrame([r[:5] for r in rows] + [(5000, None, None, None, 0), (5001, "", "en", "new", 0), (5002, "x " * 60000, "en", "s1", 1)], DOC)
    labels = spark.createDataFrame([(r[0], r[5], r[6]) for r in rows if r[0] % 2] + [(4, None, 0), (None, 1, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = {r.doc_id: r for r in quality.judged(df.withColumn("keep", F.lit("mine")), model).collect()}
    assert len(got) == 903
    held = [r for r in rows if r[0] % 2 == 0]
    right = sum(got[r[0]].keep == (r[5] == 1 and r[6] == 0) for r in held)
    assert right / len(held) > 0.98
    assert all(0 <= r.score <= 1 and 0 < r.site_share < 1 for r in got.values())
    kept = quality.keep_clean(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def plain_scores(rows):
    """(host, path, evidence) to (site share, score): shrunk shares by the method of moments, a document's own evidence left out."""

    def strength(groups, mean):
        n = sum(map(len, groups))
        if len(groups) < 2 or n <= len(groups):
            return 100.0
        shares = [sum(g) / len(g) for g in groups]
        between = sum(len(g) * (m - mean) ** 2 for g, m in zip(groups, shares, strict=True))
        noise = sum((p - m) ** 2 for g, m in zip(groups, shares, strict=True) for p in g) / (n - len(groups))
        spread = (between - (len(groups) - 1) * noise) / (n - sum(len(g) ** 2 for g in groups) / n)
        return min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1.0), 1e6)

    hosts, paths = {}, {}
    for h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    mean = sum(p for *_, p in rows) / len(rows)
    of_host, of_path = strength(list(hosts.values()), mean), strength(list(paths.values()), mean)
    out = []
    for h, q, p in rows:
        host = (sum(hosts[h]) + of_host * mean) / (len(hosts[h]) + of_host)
        share = min(max((sum(paths[h, q]) - p + of_path * host) / (len(paths[h, q]) - 1 + of_path), 1e-3), 1 - 1e-3)
        z = np.log(p / (1 - p)) + np.log(share / (1 - share)) - np.log(mean / (1 - mean))
        out.append((share, 1 / (1 + np.exp(-z))))
    return out


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_scores_equal_plain_arithmetic(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "_BROADCAST_SITES", broadcast)
    rng = random.Random(23)
    rows = [(i, sentence(rng, 30) + (" bad" * 3 if rng.random() < (0.6 if i % 3 else 0.1) else ""), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), 0) for i in range(400)]
    rows += [rows[5]] * 3 + [(None, None, "en", "a", 0)]
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int("bad" not in t), None) for i, t, *_ in rows[:200]], "doc_id long, quality int, toxic int")
    got = quality.judged(df, quality.fit(df, labels)).collect()
    assert len(got) == len(rows)
    want = plain_scores([(r.source, r.lang, r.evidence) for r in got])
    assert all(r.site_share == pytest.approx(a, rel=1e-6) and r.score == pytest.approx(b, rel=1e-6) and r.keep == (r.score >= 0.5) for r, (a, b) in zip(got, want, strict=True))


def test_a_label_takes_one_document_of_its_id(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 2)
    df = spark.createDataFrame([(1, f"text {i}", "en", "s", 1) for i in range(500)] + [(i, "x", "en", "s", 1) for i in range(2, 9)], DOC)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality._sample(df, labels, "doc_id", "text").count() == 2


def test_sparse_sites_shrink_to_the_corpus(spark):
    rows = [(0.9, "a", "x")] * 500 + [(0.1, "b", "x")] * 500 + [(0.1, "c", "y")]
    e = spark.createDataFrame([(float(np.log(p / (1 - p))), h, q) for p, h, q in rows], "_logit double, _host string, _path string")
    sites, strength, mean = quality.site_shares(e)
    share = {r["_h"]: r["host_share"] for r in sites.collect()}
    assert share["a"] > 0.85 and share["b"] < 0.15 and share["b"] < share["c"] <= mean and strength >= 1


def test_classifier_without_labels_keeps_all(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, None, None, 0)], DOC)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_clean(df, none).count() == 2 and quality.keep_clean(df.limit(0), none).count() == 0


# ------------------------------------------------------------------ 7 top-k


def test_topk_against_all_scores(spark):
    rng = np.random.default_rng(8)
    v = {int(i): rng.integers(-40, 40, 37).tolist() for i in rng.choice(10_000, 700, replace=False)}
    v |= {20_000 + i: [30] * 37 for i in range(40)} | {30_000: [1] * 5, 30_020: []}
    rows = [(i, x) for i, x in v.items()] + [(7, None), (20_000, [30] * 37), (20_000, [31] * 37)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    k = 20
    pad = {i: np.array(x + [0] * (37 - len(x))) for i, x in v.items()}
    want = set()
    for q in (i for i in pad if i % 20 == 0):
        best = sorted((-int(pad[q] @ x), i) for i, x in pad.items() if i != q)[:k]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = topk.exact_topk(df, F.col("vec_id") % 20 == 0, k)
    assert {tuple(r) for r in got.collect()} == want
    few = topk.exact_topk(df.where("vec_id >= 30000"), F.col("vec_id") % 20 == 0, k).collect()
    assert sorted(map(tuple, few)) == [(30_000, 1, 30_020, 0), (30_020, 1, 30_000, 0)]
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def block_of(ids, q, axes, least=-np.inf):
    return topk.Block(np.asarray(ids), q, axes.unit(q), np.full(len(q), float(least)))


def test_bounds_lose_nothing_and_leave_most_out():
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(30, 64)) * np.linspace(3, 0.1, 64)
    c = np.floor(20 * (centre[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 64)))).astype(np.int64)
    q, axes = c[::100], topk.Axes.of(c[:500], 64)
    scores = q @ c.T
    least = np.sort(scores, axis=1)[:, -20].astype(float)
    block = topk.Block(np.arange(-30, 0), q, axes.unit(q), least)
    i, ids, score, work = block.search(np.arange(3000), c, axes.unit(c), least, 5)
    for n in range(30):
        want = sorted(range(3000), key=lambda j: (-scores[n, j], j))[:5]
        assert ids[i == n].tolist() == want and score[i == n].tolist() == scores[n, want].tolist()
    assert work < 0.7 * 30 * 3000 * 64


def test_long_vectors_are_scored_exactly(spark):
    rng = np.random.default_rng(14)
    v = {i: rng.integers(-60, 60, 8).tolist() for i in range(60)} | {0: [96_000_001] + [3] * 7, 20: [94_906_267, 1] + [0] * 6, 41: [2**31 - 1] * 8, 43: [2**56 + 1] + [0] * 7}
    got = topk.exact_topk(spark.createDataFrame(list(v.items()), "vec_id long, v array<long>").where("vec_id != 43"), F.col("vec_id") % 20 == 0, 7).collect()
    del v[43]
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    want = {(q, r + 1, i, -s) for q in (0, 20, 40) for r, (s, i) in enumerate(sorted((-dot(q, i), i) for i in v if i != q)[:7])}
    assert {tuple(r) for r in got} == want
    c = np.array([[2**40, -(2**40)], [2, 1]])
    axes = topk.Axes.of(c, 2)
    i, ids, score, _ = block_of([1], np.array([[2**40, 2**40]]), axes).search(np.array([2, 3]), c, axes.unit(c), np.array([-np.inf]), 2)  # sums pass 64 bits on the way
    assert (i.tolist(), ids.tolist(), score.tolist()) == ([0, 0], [3, 2], [3 * 2**40, 0])


def test_zero_vectors_and_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    rng = np.random.default_rng(22)
    v = {i: ([0, 0, 0] if i % 9 == 0 else rng.integers(-5, 5, 3).tolist()) for i in range(0, 400, 2)}
    got = topk.exact_topk(spark.createDataFrame(list(v.items()), "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, 6).collect()
    score = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert {tuple(r) for r in got} == {(q, r + 1, i, -s) for q in v if q % 20 == 0 for r, (s, i) in enumerate(sorted((-score(q, i), i) for i in v if i != q)[:6])}


def test_bounds_leave_products_out_on_the_test_table(spark):
    from concordia.llm.queries import usable_vectors

    vectors = usable_vectors(spark, "/root/testdata/sf0.1")
    n, done = vectors.count(), spark.sparkContext.accumulator(0)
    topk.exact_topk(vectors, F.col("vec_id") % 20 == 0, counter=done, every_row=True).count()
    assert 0 < done.value < 0.9 * 64 * n * vectors.where("vec_id % 20 = 0").count()  # directions are even there: no bound bites before most of the mass is in


def test_every_row_of_an_id_takes_part(spark):
    df = spark.createDataFrame([(0, [1, 2]), (0, [3, -1]), (1, [5, 0]), (1, [0, 7]), (2, [1, 1])], "vec_id long, v array<long>")
    got = topk.exact_topk(df, F.col("vec_id") % 20 == 0, 4, every_row=True).collect()
    first, second = [(1, 14), (1, 5), (2, 3), (0, 1)], [(1, 15), (2, 2), (0, 1), (1, -7)]  # each query row has results of its own, the other row of its id among them
    assert sorted(map(tuple, got)) == sorted((0, r + 1, i, s) for of in (first, second) for r, (i, s) in enumerate(of))


def test_copies_null_ids_and_more_blocks_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "CANDIDATES", 8)
    rng = np.random.default_rng(31)
    rows = [(int(i), rng.integers(-6, 6, 5).tolist()) for i in rng.integers(0, 60, 400) * 5] + [(20, [1, 1, 1, 1, 1])] * 3 + [(None, [6, 6, 6, 6, 6])] * 2 + [(None, [0] * 5), (40, None), (60, []), (3, [2])]
    k, want, whole = 6, [], [(i, np.array((v + [0] * 5)[:5])) for i, v in rows if v is not None]
    for a, (q, v) in enumerate(whole):
        if q is not None and q % 20 == 0:
            best = sorted((-int(v @ w), i is None, i or 0) for b, (i, w) in enumerate(whole) if b != a)[:k]
            want += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.exact_topk(df, F.col("vec_id") % 20 == 0, k, every_row=True).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 20 * k


def test_vectors_that_can_be_used(spark, tmp_path):
    from concordia.llm.queries import labelled_vectors, usable_vectors

    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.01], 1), (None, [1.0, 1.0], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [-inf], 9), (14, [], 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {(r.vec_id, tuple(r.v)) for r in usable_vectors(spark, str(tmp_path)).collect()} == {(1, (32, -1)), (None, (64, 64)), (14, ())}
    assert {(r.vec_id, r.label) for r in labelled_vectors(spark, str(tmp_path)).collect()} == {(1, 1), (None, 2), (14, 0)}


# ------------------------------------------------------------------ 8 near copies


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(10)
    rows, i = [], 0
    for _ in range(60):
        base = sentence(rng, rng.randrange(1, 150), 5000).split()
        for _ in range(rng.randrange(1, 7)):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"n{rng.randrange(10**6)}"
            rows.append((i, (" ".join(t)).title() if rng.random() < 0.3 else ", ".join(t)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "..."), (i + 3, "one two"), (i + 4, "One, two!"), (i + 5, "w " * 30000)]
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else None
    links, parent = dict.fromkeys(sets, 0), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(None, "one two", 1)], "doc_id long, text string, label int")
    got = neardup.jaccard_classes(df).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got if r.doc_id is not None} == {d: (root(d), links[d]) for d in sets}
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d in sets if root(d) == d} | {None}


def test_a_large_group_is_checked_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    rng = random.Random(11)
    base = sentence(rng, 60, 5000).split()
    rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(90)]
    got = neardup.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 89)}


def pairs_at_the_threshold(rng, n, shared=120, own=15):
    """Texts whose shingle sets share exactly 0.8: a common run and an own end for each."""
    out = []
    for i in range(n):
        base = [f"p{i}x{rng.randrange(10**6)}" for _ in range(shared + 4)]
        out += [" ".join(base + [f"e{i}a{j}" for j in range(own)]), " ".join(base + [f"e{i}b{j}" for j in range(own)])]
    return out


def test_the_forest_meets_its_recall_at_the_threshold(spark):
    texts = pairs_at_the_threshold(random.Random(15), 1500)
    got = neardup.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.where("n_links = 1 AND class_id = doc_id - doc_id % 2").count() >= 2 * 1500 * 0.998


def test_sequences_sort_as_prefix_tries():
    rng = np.random.default_rng(16)
    forest, digits = neardup.Forest(40), rng.integers(0, 4, (50, neardup.POOL)).astype(np.uint8)
    key, deep = forest.sequences(digits)
    for t in (0, 39):
        rows = digits[:, forest.order[t]].tolist()
        assert (key[:, t] >> 48 == t).all() and sorted(range(50), key=lambda i: (key[i, t], deep[i, t], i)) == sorted(range(50), key=lambda i: (rows[i], i))


def compared(spark, n):
    """Signatures compared for n documents that share half of their words with all others."""
    rng = random.Random(17)
    common_part = [f"c{i}" for i in range(104)]
    rows = [(i, " ".join(common_part + [f"o{rng.randrange(10**9)}" for _ in range(108)])) for i in range(n)]
    counter = spark.sparkContext.accumulator(0)
    got = neardup.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), counter=counter)
    assert got.where("n_links > 0 OR class_id <> doc_id").count() == 0
    return counter.value


def test_boilerplate_does_not_tie_documents_together(spark):
    few, many = compared(spark, 1000), compared(spark, 4000)
    assert many < 8 * max(few, 1000)  # all pairs would grow 16 times
    assert many < 4000 * 40


def test_a_crowd_of_copies_is_compared_once_per_member():
    rng = np.random.default_rng(18)
    base = rng.integers(0, 256, neardup.COMPARED).astype(np.uint8)
    near = np.repeat(base[None], 5000, axis=0)
    near[np.arange(5000), rng.integers(0, neardup.COMPARED, 5000)] = 7
    far = rng.integers(0, 256, (40, neardup.COMPARED)).astype(np.uint8)
    a, b, n = neardup.spanning_ties(np.zeros(5040, np.int64), np.concatenate([near, far]), 80)
    assert len(a) == len(b) == 4999 and len(set(b.tolist())) == 4999 and n < 5040 * 45
    small = np.repeat(np.arange(3), 3)
    a, b, n = neardup.spanning_ties(small, np.concatenate([near[:3], far[:3], near[:2], far[:1]]), 80)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (0, 2), (6, 7)] and n == 9


def test_nodes_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE_ROWS", 16)
    rng = random.Random(19)
    base = sentence(rng, 60, 5000).split()
    rows = [(f"d{i:03}", " ".join([*base[:-1], f"end{i}"])) for i in range(90)] + [("e", "x"), ("f", None)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.jaccard_classes(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {f"d{i:03}": ("d000", 89) for i in range(90)} | {"e": ("e", 0), "f": ("f", 0)}


def test_texts_of_one_id_are_linked_each_by_itself(spark):
    rng = random.Random(20)
    a, b, c = sentence(rng, 50, 5000), sentence(rng, 50, 5000), sentence(rng, 50, 5000)
    df = spark.createDataFrame([(1, a), (5, a + " x"), (5, b), (5, b), (7, c), (None, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in neardup.jaccard_classes(df).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (5, 1, 1), (5, 5, 1), (5, 5, 1), (7, 7, 0)]
    assert sorted((r.doc_id or 0, r.text) for r in neardup.keep_one(df).collect()) == sorted([(0, a), (1, a), (5, b), (5, b), (7, c)])


def test_near_copies_of_an_empty_table(spark):
    assert neardup.jaccard_classes(spark.createDataFrame([], DOC)).count() == 0


# ------------------------------------------------------------------ 10 decontamination


def plain_contamination(docs, bench, window=10):
    wins = {}
    for item, t in bench:
        w = words(t)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            wins.setdefault((size, tuple(w[i : i + size])), set()).add(str(item) if item is not None else "")
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for size in {s for s, _ in wins}:
            for i in range(len(w) - size + 1):
                if found := wins.get((size, tuple(w[i : i + size]))):
                    hit |= set(range(i, i + size))
                    items |= found
        out.append((d, len(w), len(hit), ",".join(sorted(items))))
    return out


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_contamination_against_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(12)
    bench = [(i, sentence(rng, rng.choice([1, 2, 3, 5, 9, 10, 11, 25, 40]), 300)) for i in range(25)] + [(99, None), (98, ""), (97, "..."), (None, "null item words"), (3, "again " * 4)]
    pool = [words(t) for _, t in bench if words(t)]
    docs = []
    for d in range(120):
        t = sentence(rng, rng.randrange(0, 80), 300).split()
        for _ in range(rng.randrange(3)):
            src = rng.choice(pool)
            a = rng.randrange(len(src))
            at = rng.randrange(len(t) + 1)
            t[at:at] = [w.upper() for w in src[a : a + rng.randrange(1, 30)]]
        docs.append((d, " - ".join(t)))
    docs += [(500, None), (501, ""), (None, "null item words"), (7, docs[7][1]), (502, "w1 " * 60000)]
    df = spark.createDataFrame([(*r, 1, "o") for r in docs], "doc_id long, text string, n_hit int, `a.b` string")
    bf = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(df, bf).collect()), key=str)
    want = plain_contamination(docs, bench)
    assert got == sorted(want, key=str)
    clean = decontaminate.decontaminate(df, bf)
    assert clean.columns == df.columns and clean.count() == sum(x[2] == 0 for x in want)
    assert decontaminate.decontaminate(df, bf.limit(0)).count() == len(docs) and decontaminate.contamination(df.limit(0), bf).count() == 0


def test_longest_match_and_its_place(spark):
    item = [f"q{i}" for i in range(40)]
    df = spark.createDataFrame([(1, "a b " + " ".join(item[5:30]) + " c"), (2, " ".join(item[:9])), (3, " ".join(item) + " x " + " ".join(item[:12]))], "doc_id long, text string")
    got = {r.doc_id: (r.longest_match, r.longest_at, r.longest_item) for r in decontaminate.contamination(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (25, 2, "7"), 2: (0, -1, None), 3: (40, 0, "7")}


def test_an_item_longer_than_a_block_keeps_every_window(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 25)
    item = [f"q{i}" for i in range(100)]
    df = spark.createDataFrame([(i, " ".join(item[i : i + 10])) for i in range(91)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "a b")], "item_id long, text string")
    got = decontaminate.contamination(df, bench).collect()
    assert len(got) == 91 and all(r.n_hit == 10 and r["items"] == "7" for r in got)
    assert max(len(b.words) - 10 for b in decontaminate.benchmark_blocks(bench, "item_id", "text", 10)) <= 25


# ------------------------------------------------------------------ the pipeline


def plain_pipeline(rows, clean, bench):
    """Ids that reach the mix, and the texts they have by then: the stages one after another, each by all pairs."""
    rows = [r for r in rows if r[0] in clean]
    every = [(d, n, x) for d, t, *_ in rows if t is not None for n, x in enumerate(t.split("\n"))]
    kept = {d: [] for d, *_ in rows}
    for d, n, x in every:
        near = lambda y: x == y or min(len(x), len(y)) >= lines.SHORTEST and edit_at_most(x, y, 2)  # noqa: B023, E731
        if not x.strip(" ") or not any((e, m) < (d, n) and near(y) for e, m, y in every):
            kept[d].append(x)
    text = {d: t if t is None else "\n".join(kept[d]) for d, t, *_ in rows}
    was = {d: t for d, t, *_ in rows}
    text = {d: t for d, t in text.items() if t == was[d] or t.replace("\n", " ").strip(" ")}
    sets = {}
    for d, t in text.items():
        w = words(t)
        sets[d] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else None
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    text = {d: t for d, t in text.items() if group[d] == d}
    return {d: text[d] for d, _, hit, _ in plain_contamination(list(text.items()), bench) if not hit}


def test_pipeline_against_a_plain_one(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(24)
    base = ["\n".join(sentence(rng, rng.randrange(8, 25), 3000) for _ in range(3)) for _ in range(30)]
    bench = [(1, sentence(rng, 25, 9000)), (2, "tiny item")]
    texts = base + [base[0], base[1] + " end", base[2].replace("w1", "v1"), base[3] + "\n" + bench[0][1], None, "", "\n", "a tiny item here", base[4].split("\n")[0] + "x\nfresh words of its own"]
    texts += [" ".join(w + "###" for w in sentence(rng, 40).split()) for _ in range(12)]
    rows = [(i, t, "en", ["s0", "s1", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, DOC)
    clean = {r.doc_id for r in quality.keep_clean(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert clean >= {i for i, t in enumerate(texts) if t and "###" not in t} and not {i for i, t in enumerate(texts) if t and "###" in t} & clean
    want, got = plain_pipeline(rows, clean, bench), {}
    size, source, taken = {}, {r[0]: r[3] for r in rows}, {}
    for r in P.run(spark, str(tmp_path)).collect():
        assert r.text == want[r.doc_id] and r.n_chars == len(r.text or "") and r.source == source[r.doc_id]
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    for d, t in want.items():
        size[source[d]] = size.get(source[d], 0) + len((t or "").split())
    longest = max(len((t or "").split()) for t in want.values())
    assert all(abs(taken[s] - t) <= longest for s, t in plain_targets(size).items()) and max(got.values()) <= 2


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_do_what_their_operators_do(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(13)
    bench = sentence(rng, 30, 9000)
    clean = [sentence(rng, 60, 9000) + "\n" + sentence(rng, 40, 9000) for _ in range(40)]
    junk = [" ".join(w + "###" for w in sentence(rng, 50).split()) for _ in range(12)]
    extra = [clean[0], clean[1].replace("\n", "\n" + "q" * 20 + "\n"), clean[2] + " " + bench]
    texts = clean + junk + extra
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.createDataFrame(rows, DOC), []
    for _, stage in P.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), "s")
        assert docs.columns == [f.name for f in spark.createDataFrame([], DOC).schema]
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == set(range(40)) | {52, 53, 54}
    assert kept[1] == set(range(40)) | {53, 54} and kept[2] == kept[1] and kept[3] == set(range(40)) | {53}
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= kept[3] and all(r.n_chars == len(r.text) for r in out)
