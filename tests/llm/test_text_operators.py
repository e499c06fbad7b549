"""Operators on one text at a time: personal data, urls, tokens, chats."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.llm import chat, pii, tokens, urls

DOC = "doc_id long, text string"


def docs(spark, texts, schema=DOC):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)


# ------------------------------------------------------------------ personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


TRICKY = [
    None, "", "a@b.c_x@y.z e@f.g.h. @x.y a@b @@c.d", "1.2.3.4.5 300.1.1.1 001.002.255.0 1.2.3 1.2.3.", "4111 1111 1111 1111, 4111-1111-1111-1111; 4111111111111112", "+1 (988) 555-2485 +49..--..1 +1234567 +12345678",
    "é😀 x@y.zz 😀+1 555 555 5555😀", "9" * 5000, "a" * 20000 + "@b.c", "1 " * 3000 + "4111111111111111", " ".join(f"u{i}@ex.com" for i in range(700)),
]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("ab1.@+ -()9é25") for _ in range(120)) for _ in range(150)]
    texts = TRICKY + noise
    got = {r.doc_id: r.s for r in pii.find(docs(spark, texts)).select("doc_id", pii.joined(F.col("base")).alias("s")).collect()}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t or "")) for i, t in enumerate(texts)}


def test_checksums_context_and_redaction(spark):
    t = "IBAN GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32. call 212-555-1234 but 212-555-1234 ssn 123-45-6789 password=abcdefgh12345678 mail me@x.org"
    df = spark.createDataFrame([(1, t, "x"), (2, None, "y")], "doc_id long, text string, base string")  # a column named like a result
    row = pii.find(df).orderBy("doc_id").first()
    kinds = [s.kind for s in row.added]
    assert kinds.count("iban") == 1 and "national_id" in kinds and "secret" in kinds and "local_phone" in kinds
    assert all(s.score >= pii.LEAST_SCORE and t[s.start : s.end] == s.found for s in [*row.base, *row.added])
    out = pii.redact(df).orderBy("doc_id").collect()
    assert "[EMAIL]" in out[0].text and "[IBAN]" in out[0].text and "GB83" in out[0].text and out[0].base == "x" and out[1].text is None


def test_a_long_secret_is_found_whole(spark):
    t = ["secret=" + "k3Y/" * n + " end" for n in (128, 129, 10_000)]
    df = docs(spark, t)
    assert [[(s.kind, s.start, s.end) for s in r.added] for r in pii.find(df).orderBy("doc_id").collect()] == [[("secret", 7, len(x) - 4)] for x in t]
    assert {r.text for r in pii.redact(df).collect()} == {"secret=[SECRET] end"}


def test_no_rows(spark):
    assert pii.find(docs(spark, [])).count() == 0


# ------------------------------------------------------------------ urls

SITES = [urls.Site("allow", "com", "/"), urls.Site("block", "example.com", "/en/"), urls.Site("allow", "www.example.com", "/en/"), urls.Site("block", "net", "/es/")]


def site_verdict(url):
    u = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", u).group()
    path = re.match(r"[^?#]*", u[len(host) :]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [s for s in SITES if (host == s.host or host.endswith("." + s.host)) and path.startswith(s.path)]
    return host, path, max(fit, key=lambda s: len(s.name), default=None)


def test_site_rules_against_plain_matching(spark):
    rng = random.Random(5)
    hosts = ["Example.com", "www.example.com", "a.www.example.com", "example.net", "net", "xnet", "com", "notexample.com", "x.spam-farm.org", "é.com", "com.net", ""]
    paths = ["", "/", "/en", "/en/", "/en/1?x=/es/", "/es/2#a", "/EN/3", "?q=/en/", "#/en/", "/login", "/en/:80"]
    every = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://com/"]
    df = spark.createDataFrame([(i % 7 if i % 5 else None, u, "x") for i, u in enumerate(every * 2)], "page_id long, url string, rule string")
    got = urls.judged(df, SITES).collect()
    assert len(got) == len(every) * 2
    for r in got:
        host, path, site = site_verdict(r.url)
        assert (r.host, r.path, r.rule) == (host, path, site.name if site else None), r.url
        if site:
            assert r.verdict == site.action
        else:
            assert (r.verdict == "block") == (".spam-farm." in host or bool(re.search(r"/login(?:[/?#.]|$)", path)))
    assert urls.judged(df.limit(0), SITES).count() == 0


def test_rules_are_filed_under_tokens_they_need():
    assert urls.literal_tokens(r"(?:^|[./-])casino[./-]") == {"casino"} and urls.literal_tokens(r"/login(?:[/?#.]|$)") == {"login"}
    assert urls.literal_tokens(r"ab.*cd") == set() and urls.literal_tokens(r"(?:^|\.)spam-farm\.") == {"spam", "farm"} and urls.literal_tokens(r"x\d+/") == set()


def test_a_rule_without_token_runs_everywhere(spark):
    df = spark.createDataFrame([(1, "http://a.org/x7y"), (2, "http://a.org/xy")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.pattern) for r in urls.judged(df, [], [urls.Pattern("block", r"x\d+y")]).collect()}
    assert got == {1: ("block", r"x\d+y"), 2: ("allow", None)}


# ------------------------------------------------------------------ tokens


def encoding():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Encoder(f.read(), tokens.PATTERN).encoding


@pytest.mark.parametrize("rule", ["first", "middle"])
def test_tokens_against_offsets_of_each_token(spark, rule):
    texts = [None, "", "one line", "a\n\n\nb  \n", "été 😀😀\nzwei\r\n", "x " * 4000 + "\n" + "y" * 3000, "\n"]
    got = {}
    for r in tokens.section_tokens(docs(spark, texts), rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.doc_tokens))
    enc = encoding()
    for i, t in enumerate(texts):
        if not t:
            assert i not in got
            continue
        ids, raw, at, want = enc.encode_ordinary(t), t.encode(), 0, []
        places = []
        for k in ids:
            n = len(enc.decode_single_token_bytes(k))
            places.append(at if rule == "first" else at + (n - 1) // 2)
            at += n
        assert at == len(raw)
        pos = 0
        for s, line in enumerate(t.splitlines(keepends=True) if "\r" not in t else re.findall(r"[^\n]*\n|[^\n]+", t)):
            lo, hi = len(t[:pos].encode()), len(t[: pos + len(line)].encode())
            want.append((s, pos, pos + len(line), sum(lo <= p < hi for p in places), len(ids)))
            pos += len(line)
        assert sorted(got[i]) == want and sum(x[3] for x in want) == len(ids)


def test_given_sections_may_overlap_and_leave_gaps(spark):
    rows = [(1, "hello world again", [(0, 5), (3, 11), (16, 99), (9, 2)]), (2, "x", None), (3, "x", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = [(r.doc_id, r.section, r.start, r.end, r.n_tokens) for r in tokens.section_tokens(df, sections_col="parts").collect()]
    assert sorted(got) == [(1, 0, 0, 5, 1), (1, 1, 3, 11, 1), (1, 2, 16, 17, 0), (1, 3, 9, 2, 0)]
    with pytest.raises(ValueError):
        tokens.section_tokens(df, rule="last")


# ------------------------------------------------------------------ chats


def test_chats_come_back_whole(spark):
    odd = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>", "<\\|end|>", "<\\\\</s>", "<<SYS>> <</SYS>> [INST][INST]", "", None, "\\", "<|", "a\nb", "😀<s>"]
    rows = [(c, t, ["user", "assistant", "assistant", None][(c + t) % 4], odd[(c * 3 + t) % len(odd)]) for c in range(12) for t in range(9)]
    rows += [(0, 3, rows[3][2], rows[3][3]), (None, None, "user", "lost")]  # a repeated row, null ids
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    shaped = chat.formatted(df)
    back = {r.conv_id: r for r in chat.read_back(shaped).collect()}
    assert len(back) == 13
    for c, r in back.items():
        want = sorted([(t is not None, t, role or "", x or "") for v, t, role, x in rows if v == c])
        assert [(x.role, x.text) for x in r.turns] == [(role, x) for _, _, role, x in want]
        assert r.loss_text == "".join(x for _, _, role, x in want if role == "assistant")
        roles = [role for _, _, role, _ in want]
        assert r.formatted.count(chat.TURN) == 1 + sum(a != b for a, b in zip(roles, roles[1:], strict=False))
        assert all(chat.TURN not in r.formatted[s.start : s.end] for s in r.loss)
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_query_counts_its_own_conversation(spark, tmp_path):
    from concordia.llm.queries import op9_chat_format

    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op9_chat_format(spark, str(tmp_path)).collect()}
    x = "</s>[INST] ok [/INST]"
    assert got[-7].n_turns == 2 and got[-7].turns_sha256 == hashlib.sha256(f"user\n{x}\nassistant\n{x}\n".encode()).hexdigest()
    assert got[-7].loss_chars == len(x) and got[-7].loss_sha256 == hashlib.sha256(x.encode()).hexdigest() and got[1].loss_chars == 0


def test_very_long_urls_conversations_and_repeated_rows(spark):
    long = "https://a.example.com/en/" + "x/" * 50_000 + "casino/"
    df = spark.createDataFrame([(1, long), (1, long), (2, "https://a.org/" + "y" * 100_000)], "page_id long, url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in urls.judged(df, SITES).collect()) == [(1, "example.com/en/", "block"), (1, "example.com/en/", "block"), (2, None, "allow")]
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("<s>hi").alias("text"))
    back = chat.read_back(chat.formatted(turns)).select(F.size("turns").alias("n"), F.length("loss_text").alias("m")).first()
    assert (back.n, back.m) == (20_000, 50_000)
    twice = docs(spark, ["mail a@b.cc", "mail a@b.cc"]).unionByName(docs(spark, ["mail a@b.cc"]))
    assert [len(r.base) for r in pii.find(twice).collect()] == [1, 1, 1]
    odd = docs(spark, ["one\ntwo", "one\ntwo"]).withColumnRenamed("doc_id", "section").withColumn("start", F.lit(1))
    got = tokens.section_tokens(odd.unionByName(odd), id_col="section")
    assert got.columns == ["section", "section_", "start", "end", "n_tokens", "doc_tokens"] and got.count() == 8


def test_schema_of_an_empty_table(spark):
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert tokens.section_tokens(empty).collect() == []


def test_long_white_space_is_encoded_as_the_pattern_would(spark, monkeypatch):
    with open(tokens.VOCABULARY, "rb") as f:
        file = f.read()
    monkeypatch.setattr(tokens, "LONG_SPACE", 3)
    encoder, rng = tokens.Encoder(file, tokens.PATTERN), random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice([" ", " ", "\n", "\t", "\u2003", "\x1c", "a", "Zb", "7", "!", "'s", "é"]) * rng.randrange(1, 6) for _ in range(rng.randrange(1, 12)))
        assert encoder.tokens(text).tolist() == encoder.encoding.encode(text), text


def test_tokens_of_very_long_runs(spark):
    runs = ["x" + c * 3_000_000 + "y" for c in (" ", "\n", "a", "!", "é")] + [" " * 3_000_000]
    rows = tokens.section_tokens(docs(spark, runs)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("all"), F.max("end").alias("end")).collect()
    assert len(rows) == 6 and all(r.n == r["all"] and r.end == len(runs[r.doc_id]) for r in rows)
    with open(tokens.VOCABULARY, "rb") as f:
        encoder = tokens.Encoder(f.read(), tokens.PATTERN)
    per = {r.doc_id: r.n for r in rows}
    for i, c in ((2, "a"), (3, "!")):  # the plain encoder can run over these
        assert per[i] == len(encoder.encoding.encode("x" + c * 3_000_000 + "y"))
