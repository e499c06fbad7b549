"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm import chat

    extra = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(extra).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.read_back(chat.formatted(turns))
    per_turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(per_turn, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.lines import dedup_lines

    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op2_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.mixing import balanced_mix

    mixed = balanced_mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm import pii

    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = pii.joined(F.concat("base", "added")).alias("spans")
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), spans)


#: The site rules of the query.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.urls import Site, judged

    found = judged(_table(spark, sf_dir, "pages").select("page_id", "url"), [Site(*r) for r in URL_RULES])
    return found.select("page_id", "host", "path", "rule", "verdict", "pattern")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.quality import fit, judged

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = judged(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return rows.select("doc_id", "source", "lang", "evidence", "site_share", "score", "keep")


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.tokens import section_tokens

    return section_tokens(_table(spark, sf_dir, "documents"))


def usable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(_finite(F.col("embedding")))
    return usable.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double"))).alias("v"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.topk import exact_topk

    return exact_topk(usable_vectors(spark, sf_dir), F.col("vec_id") % 20 == 0, k=20, every_row=True)


def _finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.neardup import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = _table(spark, sf_dir, "embeddings").where(_finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return usable.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.negatives import hard_negatives

    return hard_negatives(labelled_vectors(spark, sf_dir), F.col("vec_id") % 100 == 0)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm import rules

    rows = rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("_row.doc_id", *rules.COUNTS, F.array_join("failed", ",").alias("failed"), "base_failed", "kept")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm import infill

    rows = infill.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1),
pair AS (SELECT m.doc_id, m.i, bi.i AS j, m.item, m.size FROM m JOIN
         (SELECT item, i, array_to_string(w[i : i + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i
          FROM (SELECT DISTINCT item, w FROM b) WHERE len(w) > 0)) bi ON bi.item = m.item
         JOIN dw ON dw.doc_id = m.doc_id AND dw.i = m.i AND dw.size = m.size AND dw.win = bi.win),
run AS (SELECT doc_id, item, i - j AS diagonal, size, i - row_number() OVER (PARTITION BY doc_id, item, i - j, size ORDER BY i) AS grp
        FROM (SELECT DISTINCT doc_id, item, i, j, size FROM pair)),
longest AS (SELECT doc_id, max(n) AS longest_match FROM (SELECT doc_id, count(*) + any_value(size) - 1 AS n FROM run GROUP BY doc_id, item, diagonal, size, grp) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


_OP1 = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
f AS (SELECT line, length(line) AS n, 8 * (length(line) // 16) AS p, min((doc_id, no)) AS at FROM l WHERE trim(line, ' ') <> '' GROUP BY line),
c AS (SELECT a.line, a.at, b.line AS other FROM f a JOIN f b ON a.n >= 16 AND b.n >= 16 AND left(a.line, 8) = left(b.line, 8) AND abs(a.n - b.n) <= 1 AND b.at < a.at
          AND left(a.line, least(a.p, b.p)) = left(b.line, least(a.p, b.p))
      UNION SELECT a.line, a.at, b.line FROM f a JOIN f b ON a.n >= 16 AND b.n >= 16 AND right(a.line, 8) = right(b.line, 8) AND abs(a.n - b.n) <= 1 AND b.at < a.at
          AND right(a.line, least(a.p, b.p)) = right(b.line, least(a.p, b.p))),
near AS (SELECT DISTINCT line FROM c WHERE levenshtein(line, other) <= 1),
k AS (SELECT l.doc_id, l.no, l.line, f.at IS NOT NULL AND (near.line IS NOT NULL OR (l.doc_id, l.no) > f.at) AS gone
      FROM l LEFT JOIN f USING (line) LEFT JOIN near USING (line)),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CAST(CASE WHEN d.text IS NOT NULL THEN length(kept) END AS BIGINT) AS kept_chars,
       CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""

#: What SQL can say of op2: sizes, source sizes and targets.  A target is the water level times the weight, or twice the source's size where that is less.
OP2_TARGETS = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY 1),
r AS (SELECT *, 2.0 * words / weight AS ratio FROM s),
l AS (SELECT *, (1.5 * (SELECT sum(words) FROM s) - coalesce(sum(2.0 * words) OVER w, 0)) / ((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0)) AS level
      FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio >= level)
SELECT doc_id, size, words AS source_size, CASE WHEN v.level IS NULL THEN 2.0 * words ELSE least(2.0 * words, v.level * weight) END AS target
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, v
"""

_HOST = "translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP4 = f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
h AS (SELECT page_id, {_HOST} AS host, regexp_extract(substr(u, length(regexp_extract(u, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
             {_HOST} || substr(u, length(regexp_extract(u, '^[^/?#]*')) + 1) AS t, row_number() OVER () AS r FROM p),
rules(action, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS verdict FROM h JOIN rules
         ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r),
pat(pattern) AS (VALUES {", ".join("('" + p + "')" for p in (r"(?:^|\.)spam-farm\.", "(?:^|[./-])casino[./-]", "(?:^|[./-])adult[./-]", "/login(?:[/?#.]|$)", "/cart(?:[/?#.]|$)", r"[?&]sessionid="))}),
other AS (SELECT r, max(pattern) AS pattern FROM h JOIN pat ON regexp_matches(t, pattern) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM h LEFT JOIN best USING (r) LEFT JOIN other USING (r)
"""

_OP7 = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.r <> c.r),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g')"
_OP9 = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, length({_ESCAPED.format("text")}) + CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 8
             ELSE 16 + length({_ESCAPED.format("role")}) + CASE WHEN row_number() OVER w > 1 THEN 7 ELSE 0 END END AS size
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) + 7 AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


_OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 10 * c >= 8 * (p.n + q.n - c)),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT doc_id, coalesce((SELECT min(other) FROM r WHERE r.doc_id = d.doc_id), doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM d
"""

_OP11 = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.r <> c.r),
p AS (SELECT ar, r AS pr, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""

_OP12_STOP = (
    "a all an and are as at be been but by for from had has have he her his i if in is it its my no not of on or our she so that the their there they this to was we were what when which who will with you "
    "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sein sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur "
    "a al como con de del el ella en era es esta este esto ha la las le lo los más me mi no nos o para pero por que se si sin sobre son su sus también un una y ya yo "
    "à au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais mes ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur tu un une vous y"
)
_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT r, x FROM win GROUP BY 1, 2 HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT win.r, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (r, x)) GROUP BY 1),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_marks,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS BIGINT) AS n_letter_words,
  CAST(len(list_filter(w, lambda x: list_contains(string_split('STOP', ' '), rtrim(lower(x), '.,;:!?')))) AS BIGINT) AS n_stop_words,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(l, lambda x: left(ltrim(x, chr(32) || chr(9)), 1) IN ('-', '*', '•'))) AS BIGINT) AS n_bullet_lines,
  CAST(len(list_filter(l, lambda x: ends_with(rtrim(x, chr(32) || chr(9) || chr(13)), '...') OR ends_with(rtrim(x, chr(32) || chr(9) || chr(13)), '…'))) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',',
  CASE WHEN n_words < 20 THEN 'few words' END, CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 'repeated windows' END,
  CASE WHEN 100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words THEN 'word length' END, CASE WHEN 100 * n_symbols > 20 * n_words THEN 'symbols' END,
  CASE WHEN 100 * n_marks > 50 * n_words THEN 'shouting' END, CASE WHEN 100 * n_letter_words < 70 * n_words THEN 'letters' END,
  CASE WHEN 100 * n_stop_words < 3 * n_words THEN 'stop words' END, CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 'repeated lines' END,
  CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 'bullets' END, CASE WHEN 100 * n_ellipsis_lines > 30 * n_lines THEN 'ellipses' END) AS failed FROM c)
SELECT *, failed = '' AS kept FROM f
""".replace("STOP", _OP12_STOP)

_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(x, i, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1 : a], '') AS pre, array_to_string(u[a + 1 : b], '') AS mid, array_to_string(u[b + 1 :], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_balanced_mix": op2_balanced_mix,
        "op3_pii": op3_pii,
        "op4_url_filter": op4_url_filter,
        "op5_quality": op5_quality,
        "op6_section_tokens": op6_section_tokens,
        "op7_exact_topk": op7_exact_topk,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_chat_format": op9_chat_format,
        "op10_decontaminate": op10_decontaminate,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_quality_rules": op12_quality_rules,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _OP1, "op4_url_filter": _OP4, "op7_exact_topk": _OP7, "op8_ngram_jaccard": _OP8, "op9_chat_format": _OP9, "op10_decontaminate": _OP10, "op11_hard_negatives": _OP11, "op12_quality_rules": _OP12, "op13_fill_in_middle": _OP13}
