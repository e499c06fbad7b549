"""Line dedup by a deletion-neighbourhood join; DataFrame functions only.

A line is dropped if the same line, or one at most ``edits`` (1 or 2) character edits away, stands
earlier in the corpus; earlier is a smaller id, then a smaller line number.  Blank lines stay.
Lines shorter than ``shortest`` characters (16 unless given) are dropped only for equal ones: in a
few characters, two edits make another word.

Variants.  Two lines of one length are one substitution apart if they agree after deleting the
character at some position: the variant carries position and length.  They are one insertion apart
if the shorter one equals the longer one with a character deleted.  All variants travel as
hashed keys, and a key's group only ever yields its earliest members, so a group of any size makes
one row per member; every (line, earlier line) pair is then verified by its edit distance.

Where variants are emitted.  A line of 300 characters has 300 variants, and nearly all lines have
no neighbour at all.  So the place of a possible edit is narrowed first, without loss: cut at a
grid that depends on the length's class only, one edit leaves all but one segment of both lines
equal.  Keys of "all but segment j" over 2 segments choose the lines whose text is fetched, keys
over 8 segments choose the segments in which they may differ, and variants are made there only.

Two edits.  Keys of "all but two of 3 segments" choose the lines.  What stands between the two left
out may have moved by one character, so it is taken from three places.  Then every open pair of
segments is halved again and again.  Lines of one key differ in what is left out only; where a key
has few of them, those texts are compared at once, each with the earlier ones, and only the lines
that have a near one leave the group.  The pairs of segments of keys that many lines share stay
open.  Where those are a few characters wide, variants with up to two characters deleted are made.
Every step keeps all lines two edits apart.

Short lines.  Below 16 characters there is no grid; if ``shortest`` asks for them, all variants of
those lines, and of the ones up to two characters longer, are made.

Defined results: null texts stay null; text is split at line feeds only; rows with a null id
come first; rows with equal ids are one document, whose lines of equal number tie and stay; an
empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import interim, packed, quoted, unpacked, written

#: Characters of the shortest line that a grid is laid over, and the width of a length class.
SHORTEST, CLASS = 16, 16
#: For two edits: lines of a key, and characters left out of them, up to which they are compared at once, and the width that ends the halving.
FEW, FEW_CHARACTERS, NARROW = 256, 1 << 20, 2


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(F.col(quoted(text_col)).cast("string")).alias("th"), F.posexplode(F.split(F.col(quoted(text_col)).cast("string"), "\n", -1)).alias("no", "line"))
    rows = rows.where(F.trim("line") != "")
    return rows.select("id", "th", "no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _right(line: Column, n: Column, size: Column) -> Column:
    return F.substr(line, n - size + 1, size)


def _segment_keys(line: Column, n: Column, segments: int) -> Column:
    """Array of (class, segment, key): the line's hash without each segment of its length class's grid.

    A line as long as its class begins is also cut by the grid of the class before, where the lines
    one character shorter are.
    """
    own = F.floor(n / CLASS).cast("int")
    classes = F.when(n < SHORTEST, F.array().cast("array<int>")).when((n % CLASS == 0) & (n > SHORTEST), F.array(own, own - 1)).otherwise(F.array(own))

    def of(c: Column) -> Column:
        width = c * (CLASS // segments)
        key = lambda j: F.xxhash64(F.lit(segments), c, j, F.substr(line, F.lit(1), j * width), _right(line, n, (segments - 1 - j) * width))
        return F.transform(F.array(*[F.lit(j) for j in range(segments)]), lambda j: F.struct(c.alias("c"), j.alias("j"), key(j).alias("key")))

    return F.flatten(F.transform(classes, of))


def _half_keys(line: Column, n: Column) -> Column:
    """The keys of ``_segment_keys`` for two segments, spelled out for the pass over all lines: its expressions are compiled, per-element functions are not."""
    own = F.floor(n / CLASS).cast("int")

    def of(c: Column) -> list[Column]:
        width = c * (CLASS // 2)
        return [F.xxhash64(F.lit(0), c, _right(line, n, width)), F.xxhash64(F.lit(1), c, F.substr(line, F.lit(1), width))]

    return F.when((n % CLASS == 0) & (n > SHORTEST), F.array(*of(own), *of(own - 1))).otherwise(F.array(*of(own)))


def _shared(keys: DataFrame) -> DataFrame:
    """Keys that at least two different lines have; written, so that joins with them are between two shuffles and a very common key's rows can be split."""
    return written(keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("key"), "shared")


def _variants(line: Column, n: Column, c: Column, j: Column) -> Column:
    """Array of (role, key) for the positions of segment j: 0 a substitution's variant, 1 the line itself, 2 the line without a character."""
    width = c * (CLASS // 8)
    place = F.sequence(j * width, n - (7 - j) * width - 1)
    rest = lambda i: (F.substr(line, F.lit(1), i), F.substr(line, i + 2))
    swapped = F.transform(place, lambda i: F.struct(F.lit(0).alias("role"), F.xxhash64(F.lit(0), n, i, *rest(i)).alias("key")))
    without = F.transform(place, lambda i: F.struct(F.lit(2).alias("role"), F.xxhash64(F.lit(1), F.concat(*rest(i))).alias("key")))
    itself = F.array(F.struct(F.lit(1).alias("role"), F.xxhash64(F.lit(1), line).alias("key")))
    own_class = F.floor(n / CLASS) == c
    return F.concat(F.when(own_class, F.concat(swapped, itself)).otherwise(F.array().cast("array<struct<role:int,key:bigint>>")), without)


def _with_earlier(group: DataFrame, near) -> DataFrame:
    """``(h1, h2)`` of the members of the small groups ``of``, structs of (me, ...) in order, that an earlier member is ``near`` to."""
    found = F.filter("of", lambda x, i: F.exists(F.slice("of", F.lit(1), i), lambda y: (y["me"]["at"] < x["me"]["at"]) & near(x, y)))
    return written(group.select(F.explode(found).alias("x")).select("x.me.h1", "x.me.h2").distinct(), "near")


def _variant_rows(candidates: DataFrame) -> DataFrame:
    """``(me, role, key)``: the variants of candidate lines (h1, h2, n, at, line) in the segments in which another candidate may differ."""
    cut = candidates.select("h1", "h2", F.explode(_segment_keys(F.col("line"), F.col("n"), 8)).alias("s")).select("h1", "h2", "s.*")
    open_ = cut.join(_shared(cut), "key", "left_semi").select("h1", "h2", "c", "j").distinct()
    rows = candidates.join(open_, ["h1", "h2"]).select(F.struct("at", "h1", "h2").alias("me"), F.explode(_variants(F.col("line"), F.col("n"), F.col("c"), F.col("j"))).alias("v"))
    return rows.select("me", "v.role", "v.key")


def _near_one(candidates: DataFrame) -> DataFrame:
    """``(h1, h2)`` of candidate lines that an earlier candidate is one edit away from: equal variants joined, whatever the size of their group."""
    rows = _variant_rows(candidates)
    first = rows.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("me"))).alias(f"m{r}") for r in (0, 1, 2)], F.min("me.h1").alias("a"), F.max("me.h1").alias("b"))
    first = written(first.where("a < b").drop("a", "b"), "first")
    partner = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = rows.join(first, "key").select("me", partner.alias("you")).where(F.col("you.at") < F.col("me.at"))
    return _verified(pairs, candidates, 1)


def _edge(c: Column, j: Column, segments: int) -> Column:
    """Where segment j of a class's grid begins; the grid of twice the segments has the same edges and one between any two."""
    return F.floor(c * CLASS * j / segments).cast("int")


def _third_keys(line: Column, n: Column) -> Column:
    """Array of (place, key): the line's hash without two of three segments; place is three times the class plus 0 for segments 0 and 1, 1 for 1 and 2, 2 for 0 and 2."""
    own = F.floor(n / CLASS).cast("int")
    pair = lambda c, i, key: F.struct((c * 3 + i).alias("place"), key.alias("key"))

    def of(c: Column) -> list[Column]:
        a, b = _edge(c, F.lit(1), 3), _edge(c, F.lit(2), 3)
        middle = [pair(c, 2, F.xxhash64(F.lit(2), c, F.substr(line, a + 1 + d, b - a))) for d in (-1, 0, 1)]
        return [pair(c, 0, F.xxhash64(F.lit(0), c, _right(line, n, c * CLASS - b))), pair(c, 1, F.xxhash64(F.lit(1), c, F.substr(line, F.lit(1), a))), *middle]

    return F.when((n % CLASS < 2) & (n >= 2 * CLASS), F.array(*of(own), *of(own - 1))).otherwise(F.array(*of(own)))


def _halved(candidates: DataFrame, open_: DataFrame, segments: int) -> DataFrame:
    """``(me, c, j1, j2, key, u, v, far)`` of lines without two of ``segments`` segments, those that lie in their open pairs (h1, c, j1, j2) of half as many.

    Both edits in one segment are met with its sibling; edits in two segments with both of these.
    ``u`` and ``v`` are what is left out.  If all lines of a key have one ``u``, or one ``v``,
    any edits between them also fit in the other place alone; where the two places are ``far``, with
    more between them than either may hold, that is met by a pair of near segments.
    """
    cell = lambda i: F.col(f"o{i // 2 + 1}") * 2 + i % 2
    moves = [(i, k, d) for i in range(4) for k in range(i + 1, 4) for d in (-1, 0, 1)]
    choice = F.array(*[F.struct(cell(i).alias("j1"), cell(k).alias("j2"), F.lit(d).alias("d")) for i, k, d in moves])
    rows = candidates.join(open_.select("h1", "c", F.col("j1").alias("o1"), F.col("j2").alias("o2")), "h1")
    rows = rows.select(F.struct("at", "h1", "h2").alias("me"), "line", "n", "c", F.explode(choice).alias("s")).select("me", "line", "n", "c", "s.*").where("d = 0 OR j2 > j1 + 1")
    c, line = F.col("c"), F.col("line")
    at = lambda j: _edge(c, j, segments)
    before, middle, after = at(F.col("j1")), at(F.col("j1") + 1), at(F.col("j2") + 1)
    d, to, right = F.col("d"), at(F.col("j2")), c * CLASS - after
    parts = [F.substr(line, F.lit(1), before), F.substr(line, middle + 1 + d, to - middle), _right(line, F.col("n"), right)]
    key = F.xxhash64(F.lit(segments), "c", "j1", "j2", *parts).alias("key")
    u, v = F.substr(line, before + 1, middle + d - before), F.substr(line, to + d + 1, F.col("n") - right - to - d)
    near = F.col("j2") == F.col("j1") + 1  # one place of two segments: what is inserted in the first moves into the second
    u, v = F.when(near, F.concat(u, v)).otherwise(u), F.when(near, F.lit("")).otherwise(v)
    far = to - middle > c * CLASS / segments + CLASS + 5
    return rows.select("me", "c", "j1", "j2", key, u.alias("u"), v.alias("v"), far.alias("far"))


def _double_variants(line: Column, n: Column, places: Column) -> Column:
    """Array of (role, key) of the line (0) and of it without one (1, 3) or two (2, 4, 5) of the characters at ``places``.

    A key carries what remains, for roles 3 and 4 also where one character was deleted, for role 5 where
    both were.  Lines that share a key in roles 0 and 1, 0 and 2, 1 and 1, 3 and 4 or 5 and 5 are two edits apart at most.
    """
    cut = lambda i, j: F.concat(F.substr(line, F.lit(1), i), F.substr(line, i + 2, j - i - 1), F.substr(line, j + 2))
    keyed = lambda role, *what: F.struct(F.lit(role).alias("role"), F.xxhash64(*what).alias("key"))

    def one(i: Column) -> Column:
        rest = F.concat(F.substr(line, F.lit(1), i), F.substr(line, i + 2))
        return F.array(keyed(1, F.lit(10), rest), keyed(3, F.lit(11), i, rest))

    def two(i: Column, j: Column) -> Column:
        rest = cut(i, j)
        return F.array(keyed(2, F.lit(10), rest), keyed(4, F.lit(11), i, rest), keyed(4, F.lit(11), j - 1, rest), keyed(5, F.lit(12), i, j - 1, rest))

    ones = F.flatten(F.transform(places, one))
    twos = F.flatten(F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: two(i, j)))))
    return F.concat(F.array(keyed(0, F.lit(10), line)), ones, twos)


#: Roles of variants whose common key shows lines to be one edit apart, and two at most.
_PARTNERS = {1: {0: (1,), 1: (0,), 3: (3,)}, 2: {0: (1, 2), 1: (0, 1), 2: (0,), 3: (4,), 4: (3,), 5: (5,)}}


def _earlier(rows: DataFrame, edits: int) -> DataFrame:
    """``(me, you)``: lines of (me, role, key) with the earliest of those that a key shows to be so many edits apart at most."""
    partners = _PARTNERS[edits]
    first = rows.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("me"))).alias(f"m{r}") for r in partners], F.min("me.h1").alias("a"), F.max("me.h1").alias("b"))
    first = written(first.where("a < b").drop("a", "b"), "first")
    you = F.coalesce(*[F.when(F.col("role") == r, F.least(*[F.col(f"m{p}") for p in ps]) if len(ps) > 1 else F.col(f"m{ps[0]}")) for r, ps in partners.items()])
    return rows.join(first, "key").select("me", you.alias("you")).where(F.col("you.at") < F.col("me.at"))


def _verified(pairs: DataFrame, candidates: DataFrame, edits: int) -> DataFrame:
    """``(h1, h2)`` of the lines of (me, you) that are so many edits apart at most."""
    pairs = pairs.select("me.h1", "me.h2", F.col("you.h1").alias("g1"), F.col("you.h2").alias("g2")).distinct()
    text = candidates.select("h1", "h2", "line")
    both = pairs.join(text, ["h1", "h2"]).join(text.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other")), ["g1", "g2"])
    return both.where(F.levenshtein("line", "other", edits) >= 0).select("h1", "h2").distinct()


def _near_short(candidates: DataFrame, shortest: int, edits: int) -> DataFrame:
    """``(h1, h2)`` of the candidate lines without a grid, and of the ones little longer, that an earlier one is near to."""
    some = candidates.where((F.col("n") >= shortest) & (F.col("n") < SHORTEST + edits))
    variants = F.filter(_double_variants(F.col("line"), F.col("n"), F.sequence(F.lit(0), F.col("n") - 1)), lambda v: v["role"].isin(*_PARTNERS[edits]))
    rows = some.select(F.struct("at", "h1", "h2").alias("me"), F.explode(variants).alias("v")).select("me", "v.role", "v.key")
    return _verified(_earlier(rows, edits), some, edits)


def _near_two(candidates: DataFrame, open_: DataFrame) -> DataFrame:
    """``(h1, h2)`` of candidate lines (h1, h2, n, at, line) that an earlier candidate is at most two edits away from; ``open_`` has their pairs (h1, c, j1, j2) of three segments."""
    found, narrow, segments = [], [], 3
    within = lambda x, y: (F.levenshtein(x["u"], y["u"], 2) >= 0) & (F.levenshtein(x["v"], y["v"], 2) >= 0) & (F.levenshtein(x["u"], y["u"], 2) + F.levenshtein(x["v"], y["v"], 2) <= 2)
    while True:
        segments *= 2
        rows = _halved(candidates, open_, segments)
        ends = [f(F.xxhash64(x)).alias(f"{f.__name__}_{x}") for x in ("u", "v") for f in (F.min, F.max)]
        size = rows.groupBy("key").agg(F.min("me.h1").alias("a"), F.max("me.h1").alias("b"), F.count("*").alias("m"), F.max(F.length("u") + F.length("v")).alias("chars"), F.first("far").alias("far"), *ends)
        size = size.where("a < b AND NOT (far AND (min_u = max_u OR min_v = max_v))")
        size = written(size.select("key", ((F.col("m") <= FEW) & (F.col("m") * F.col("chars") <= FEW_CHARACTERS)).alias("few")), "size")
        hit = written(rows.drop("far").join(size, "key"), "hit")
        group = hit.where("few").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("me", "u", "v"))).alias("of"))
        found.append(_with_earlier(group, within))
        rest = hit.where("NOT few").select("me.h1", "c", "j1", "j2").distinct()
        done = F.col("c") * CLASS <= NARROW * segments
        narrow.append(rest.where(done).withColumn("segments", F.lit(segments)))
        open_ = written(rest.where(~done), "open")
        if open_.isEmpty():
            break
    last = narrow[0]
    for more in narrow[1:]:
        last = last.union(more)
    edge = lambda j: F.floor(F.col("c") * CLASS * j / F.col("segments")).cast("int")
    end = F.col("n") - 1
    span = lambda j, first: F.sequence(first, F.when(j + 1 == F.col("segments"), end).otherwise(F.least(edge(j + 1), end)))
    places = F.array_sort(F.array_union(span(F.col("j1"), edge(F.col("j1"))), span(F.col("j2"), edge(F.col("j2")) - 1)))
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows that make very many
    rows = candidates.join(last, "h1").repartition(parts, "h1", "c", "j1", "j2", "segments").select(F.struct("at", "h1", "h2").alias("me"), F.explode(_double_variants(F.col("line"), F.col("n"), places)).alias("v"))
    every = _verified(_earlier(rows.select("me", "v.role", "v.key"), 2), candidates, 2)
    for more in found:
        every = every.union(more)
    return every.distinct()


def _dropped(docs: DataFrame, id_col: str, text_col: str, edits: int, shortest: int) -> DataFrame:
    """``(_doc, _th, drop)``: of each text that loses lines, their sorted numbers."""
    lines = _lines(docs, id_col, text_col)
    with interim(docs.sparkSession) as keep:
        n = F.length("line").cast("int")
        if edits == 1:
            halves = lines.where(n >= SHORTEST).select("h1", "h2", F.explode(_half_keys(F.col("line"), n)).alias("key"))
            likely = written(halves.join(_shared(halves).hint("shuffle_hash"), "key", "left_semi").select("h1", "h2").distinct(), "likely")
        else:
            thirds = lines.where(n >= SHORTEST).select("h1", "h2", F.explode(_third_keys(F.col("line"), n)).alias("k")).select("h1", "h2", "k.*")
            places = written(thirds.join(_shared(thirds).hint("shuffle_hash"), "key", "left_semi").select("h1", "h2", "place").distinct(), "places")
            likely = places.select("h1", "h2").distinct()
        known = lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "no")).alias("at"), F.count("*").alias("copies"), F.first("line").alias("line"))
        known = known.join(likely.withColumn("candidate", F.lit(True)).hint("shuffle_hash"), ["h1", "h2"], "left")
        is_short = (n >= shortest) & (n < SHORTEST + edits) if shortest < SHORTEST else F.lit(False)
        known = written(known.select("h1", "h2", "at", "copies", F.when(F.col("candidate") | is_short, F.col("line")).alias("line")), "known")
        candidates = known.where("line IS NOT NULL").select("h1", "h2", F.length("line").cast("int").alias("n"), "at", "line")
        gridded = candidates.where(F.col("n") >= SHORTEST)
        if edits == 1:
            near = _near_one(gridded)
        else:
            pair = F.col("place") % 3
            open_ = places.select("h1", F.floor(F.col("place") / 3).cast("int").alias("c"), F.when(pair == 1, 1).otherwise(0).alias("j1"), F.when(pair == 0, 1).otherwise(2).alias("j2"))
            near = _near_two(gridded, open_)
        if shortest < SHORTEST:
            near = near.union(_near_short(candidates, shortest, edits)).distinct()
        near = written(near, "near").withColumn("near", F.lit(True))
        repeated = keep(written(known.select("h1", "h2", "at", "copies").join(near, ["h1", "h2"], "left").where("copies > 1 OR near"), "repeated"))
    hit = lines.select("h1", "h2", "id", "th", "no").join(repeated.hint("shuffle_hash"), ["h1", "h2"])
    hit = hit.where(F.coalesce("near", F.lit(False)) | (F.struct("id", "no") > F.col("at")))
    return hit.groupBy(F.col("id").alias("_doc"), F.col("th").alias("_th")).agg(F.array_sort(F.collect_set("no")).alias("drop"))


def _kept(lines: Column, drop: Column) -> Column:
    """The lines but those of the sorted numbers, as the slices between these: a text costs its length however many it loses."""
    before = lambda i: F.when(i == 0, -1).otherwise(F.get(drop, i - 1))
    slices = F.transform(drop, lambda d, i: F.slice(lines, before(i) + 2, d - before(i) - 1))
    rest = F.slice(lines, F.element_at(drop, -1) + 2, F.size(lines))
    return F.concat(F.flatten(slices), rest)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, edits: int = 1, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` without their repeated lines, equal or at most ``edits`` (1 or 2) apart; with ``counts`` also ``n_lines`` and ``n_dropped``, which replace columns of the same name."""
    if edits not in (1, 2) or shortest < 1:
        raise ValueError("edits must be 1 or 2, shortest 1 or more")
    own = {"_id": id_col, "_text": text_col}
    drop = _dropped(docs, id_col, text_col, edits, shortest)
    rows = packed(docs, **own).withColumn("_text", F.col("_text").cast("string"))
    rows = rows.join(drop.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("_text") == F.col("_th")), "left")
    rows = rows.withColumn("_lines", F.split("_text", "\n", -1))
    new = F.when(F.col("drop").isNull(), F.col("_text")).otherwise(F.array_join(_kept(F.col("_lines"), F.col("drop")), "\n"))
    more = ()
    if counts:
        more = ("n_lines", "n_dropped")
        before = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines"))
        rows = rows.withColumns({"n_lines": before.cast("long"), "n_dropped": F.coalesce(F.size("drop"), F.lit(0)).cast("long")})
    return unpacked(rows.withColumn("_text", new), docs, own, *more)
