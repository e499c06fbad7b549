"""Quality rules, fill-in-the-middle and hard negatives against plain versions."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.llm import infill, negatives, rules

# ------------------------------------------------------------------ quality rules


def plain_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    again = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 8)}
    stop = {w for ws in rules.STOP_WORDS.values() for w in ws}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in rules.SYMBOLS for c in t), "n_marks": t.count("!"),
        "n_letter_words": sum(any(c.isalpha() for c in w) for w in words), "n_stop_words": sum(w.lower().rstrip(".,;:!?") in stop for w in words), "n_repeat_words": len(again),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_bullet_lines": sum(x.lstrip(" \t")[:1] in ("-", "*", "•") for x in lines),
        "n_ellipsis_lines": sum(x.rstrip(" \t\r").endswith(("...", "…")) for x in lines),
    }


def prose(rng, n):
    return " ".join(rng.choice("the of river stone and light über niño é😀 don't 12 -- to in".split()) for _ in range(n))


def rule_texts():
    rng = random.Random(5)
    loop = " ".join(f"w{i % 9}" for i in range(400))
    return [
        None, "", " \t\n\x0b\x0c\r ", "a", "one two three four five six seven eight", "x " * 8, "x " * 9, "x y z a\u0085b \x00 c", "$$$ ### a|b <c> & %", "- a\n* b\n• c\n\n - d...\n e…\r\n- a\n", "Stop! The! OF, und; à?",
        loop, "q " + loop + " r", "a b c d e f g h a b c d e f g h", "a b c d e f g h i a b c d e f g h", "é😀 " * 30, "\n".join(["same line here"] * 40), prose(rng, 19), prose(rng, 20),
    ] + [prose(rng, rng.randrange(10, 200)) for _ in range(40)]


def test_counts_and_verdicts_equal_the_plain_ones(spark):
    texts = rule_texts()
    rows = rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_counts(texts[r["_row"]["doc_id"]])
        assert {c: r[c] for c in rules.COUNTS} == want, texts[r["_row"]["doc_id"]]
        assert r.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        failed = []
        for rule in rules.TABLE:
            value, unit = (100 * want[rule.of], want[rule.per]) if rule.per else (want[rule.of], 1)
            if (rule.least is not None and value < rule.least * unit) or (rule.most is not None and value > rule.most * unit):
                failed.append(rule.name)
        assert r.failed == failed and r.kept == (not failed)


def test_rules_of_a_very_long_text_of_clashing_columns_and_of_an_empty_table(spark):
    rng = random.Random(1)
    long = prose(rng, 300_000)
    df = spark.createDataFrame([(1, long, 7, "x"), (1, long, 7, "x"), (2, None, None, None)], "doc_id long, text string, n_words long, _words string")
    rows = rules.judged(df).collect()
    want = plain_counts(long)
    assert [r.n_repeat_words for r in rows if r["_row"]["doc_id"] == 1] == [want["n_repeat_words"]] * 2
    assert rules.keep(df).columns == df.columns and {r.n_words for r in rules.keep(df).collect()} <= {7}
    assert rules.judged(df.limit(0)).count() == 0
    assert rules.judged(df, table=()).where("kept").count() == 3


def test_rules_are_one_projection_without_user_functions(spark):
    plan = rules.judged(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ScalaUDF" not in plan


# ------------------------------------------------------------------ fill-in-the-middle


def plain_infill(doc_id, t):
    t = t or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def infill_texts():
    rng = random.Random(9)
    noise = ["".join(rng.choice(["a", "Zb", " ", "é", "😀", "<", ">", "P", "S", "M", "\n", "1", "\x00", "中"]) for _ in range(rng.randrange(0, 90))) for _ in range(300)]
    return [None, "", "a", "<P", "<", "x<P>y", "a" * 5000, "😀" * 3000, "ab1" * 4000, *noise]


@pytest.mark.parametrize("every", [1, 3, 1024])
def test_infill_equals_the_plain_version_and_can_be_undone(spark, every):
    texts = infill_texts()
    df = spark.createDataFrame([(i if i % 50 else None, i, t) for i, t in enumerate(texts)], "doc_id long, no long, text string")
    rows = infill.fill_in_middle(df, every=every).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(r.doc_id, texts[r.no]), texts[r.no]
        assert r.back == (texts[r.no] or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_checkpoints_over_pieces_find_every_unit(monkeypatch):
    monkeypatch.setattr(infill, "PIECE", 7)
    for t in infill_texts()[2:]:
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t[:400])
        index = infill.Checkpoints(np.frombuffer(t[:400].encode(), np.uint8), 4)
        ends = np.cumsum([0, *map(len, units)])
        assert index.n == len(units) and [index.point(u) for u in range(len(units) + 1)] == ends.tolist()
        assert len(index.units) == -(-len(units) // 4)


def test_infill_of_clashing_columns_long_texts_and_an_empty_table(spark):
    long = "word, " * 700_000
    df = spark.createDataFrame([(3, long, "mine", 1), (3, long, "mine", 2)], "doc_id long, text string, output string, _cut long")
    out = infill.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "_cut", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.collect()
    assert len(rows) == 2 and all(tuple(r)[3:] == plain_infill(3, long) for r in rows)
    assert infill.fill_in_middle(df.limit(0)).count() == 0
    assert {r.form for r in infill.fill_in_middle(df, rate=0).collect()} == {"plain"} and {r.form for r in infill.fill_in_middle(df, rate=100, spm_rate=100).collect()} == {"spm"}


# ------------------------------------------------------------------ hard negatives

V = "vec_id long, label int, v array<long>"
_key = lambda r: (-r[0], r[1] is None, r[1] or 0)


def plain_negatives(rows, k=5, n_each=5):
    rows = [(i, lab, v) for i, lab, v in rows if lab is not None and v is not None and None not in v]
    out = []
    for a, (aid, lab, v) in enumerate(rows):
        if aid is None or aid % 100:
            continue
        near = [(sum(x * y for x, y in zip(v, w)), i, m) for b, (i, m, w) in enumerate(rows) if b != a]
        for p, pid, _ in sorted((r for r in near if r[2] == lab), key=_key)[:k]:
            fit = sorted((r for r in near if r[2] != lab and 80 * p <= 100 * r[0] <= 100 * p), key=_key)[:n_each]
            out += [(aid, pid, n + 1, i, p, s) for n, (s, i, _) in enumerate(fit)]
    return sorted(out, key=repr)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, V)
    return sorted((tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect()), key=repr)


def vectors(rng, n, dims, labels, size=40, spread=0.35):
    centre = rng.normal(size=(labels, dims))
    out = []
    for i in range(n):
        lab = int(rng.integers(labels))
        out.append((i, lab, [int(x) for x in np.floor(size * (centre[lab] * spread + centre[0] + rng.normal(size=dims) * 0.3))]))
    return out


@pytest.mark.parametrize("dims", [1, 3, 24])
def test_negatives_equal_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(negatives, "CANDIDATES", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = np.random.default_rng(dims)
    rows = vectors(rng, 900, dims, 4)
    got = mined(spark, rows)
    assert got == plain_negatives(rows) and got


def test_negatives_with_copies_ties_nulls_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 16)
    rng = np.random.default_rng(2)
    rows = vectors(rng, 120, 4, 3, size=4)
    rows += [rows[100], rows[100], (100, 1, [1, 2, 3, 4]), (100, 1, [4, 3, 2, 1]), rows[7], rows[7], rows[7]]  # copies of an anchor, others of its id
    rows += [(None, 1, [5, 5, 5, 5]), (None, 1, [5, 5, 5, 5]), (None, 2, [5, 5, 5, 5]), (200, None, [1, 1, 1, 1]), (300, 1, None), (400, 2, [1, None, 1, 1]), (500, 0, []), (600, 1, [3]), (601, 2, [9, 9, 9, 9, 9, 9])]
    rows += [(1000 + i, i % 2, [2, 2, 2, 2]) for i in range(40)]  # ties
    got = mined(spark, rows)
    assert got == plain_negatives(rows) and any(r[3] is None or r[1] is None for r in got)


def test_negatives_of_large_numbers_zeros_and_negative_scores(spark):
    big = 1 << 30
    rows = [(100 * i, i % 2, [big + i, big - i, 7]) for i in range(12)] + [(i, i % 2, [big - i, big, -7 * i]) for i in range(1, 60)]
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, [(0, 0, []), (1, 0, []), (2, 1, []), (3, 1, [])]) == plain_negatives([(0, 0, []), (1, 0, []), (2, 1, []), (3, 1, [])])
    away = [(0, 0, [5]), (1, 0, [-5]), (2, 1, [-5]), (3, 1, [4])]
    assert mined(spark, away) == []
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1]), (2, 2, [1])]) == []
    assert mined(spark, rows, positives=2, negatives=1) == plain_negatives(rows, 2, 1)


def test_most_products_are_never_made_where_vectors_have_structure(spark):
    rng = np.random.default_rng(4)
    n, dims = 6000, 64
    scale = 1.0 / (1 + np.arange(dims))
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    x = np.floor(1000 * (rng.normal(size=(n, dims)) * scale) @ turn).astype(int)
    rows = [(i, int(rng.integers(3)), v.tolist()) for i, v in enumerate(x)]
    made = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, V)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, counter=made).collect()
    all_ = 60 * n * dims * (1 / 3 + 1)
    assert got and made.value < 0.5 * all_, made.value / all_
    assert json.dumps(sorted(map(list, got))) == json.dumps(sorted(map(list, plain_matrix(rows))))


def plain_matrix(rows):
    """As ``plain_negatives``, with a matrix."""
    ids, lab, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    out = []
    for a in np.flatnonzero(ids % 100 == 0):
        score = v @ v[a]
        order = np.lexsort((ids, -score))
        order = order[order != a]
        for p in order[lab[order] == lab[a]][:5]:
            fit = [j for j in order if lab[j] != lab[a] and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:5]
            out += [(int(ids[a]), int(ids[p]), n + 1, int(ids[j]), int(score[p]), int(score[j])) for n, j in enumerate(fit)]
    return out
