"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Targets: the sources, in code point order with null last, weigh 5, 2, 1, repeating, and share a
multiple of all words; a target stops at ``cap`` times its source's words, and the excess is
shared again by weight (water filling over one row per source).

Rates: among all document rates that meet a source's target, the balanced ones are nearest to 1
in relative entropy, which makes them ``min(cap, exp(a * size / mean size))``; the multiplier
``a`` of each source is the root of the convex dual's gradient.  Newton's method is held in a
bracket that the least and the mean size give, and goes on until every source's expected words
are within ``RESIDUAL`` of its target; if they never are, that is an error.  All sources' rounds
run together as windows over the counts of documents per (source, size), so no round reads
documents again, and a hot source is as many rows as it has distinct sizes.

Copies: a rate's whole part is taken, and its fraction is rounded by sequential Poisson
sampling: documents in the order of hash / fraction are taken until the source's words reach its
target.  The place where that happens is found by two rounds of sums over 512 levels and a
window over the last level alone.  The order is of the hash of id and text, so every document's
copies follow from its own row and one row of its source, and reruns agree.  Rows equal in id and
text share a place.  Last, where a source is off its target by more than a thousandth, a few of its
documents are turned the other way, which brings it nearer.  Where the cut falls among equal rows, or one of several is turned, those
rows alone are numbered and so many of them rounded up.

Defined results: a null text has size 0; a document of size 0 takes no words and gets one copy
if its source's target is above 0; an empty source has target 0; repeated rows and rows without
an id are documents of their own; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordia.llm.common import interim, packed, quoted, unpacked, written

_LEVELS = 512
#: A side of up to so many sources (one short row each) is broadcast, else joined by a shuffle.
_BROADCAST_SOURCES = 50_000
#: How near, relatively, a source's expected words come to its target; rounds of Newton in one job, and such jobs at most.
RESIDUAL, _ROUNDS, _JOBS = 1e-6, 8, 24
#: Documents of a source that are rounded the other way, about, and the share of its target within which it is left alone.
_TURNS, _NEAR = 6, 1e-3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` (source, words, ...) and the ``target`` of each."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sources.withColumn("weight", weight).withColumn("limit", cap * F.col("words")).withColumn("ratio", F.col("limit") / F.col("weight"))
    left = share * F.sum("words").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / weight_left)  # the level if all before this source are full
    open_ = F.col("ratio") >= F.col("level")
    t = t.withColumn("level", F.min(F.when(open_, F.struct("ratio", "level"))).over(everything)["level"])
    return t.withColumn("target", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))).drop("weight", "limit", "ratio", "level")


def _rate(multiplier: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(multiplier * size / mean, F.lit(50.0))))


def _multipliers(sizes: DataFrame, cap: float) -> DataFrame:
    """``(source, a, whole)``: the multiplier of each source, and the words of its rates' whole parts.

    ``sizes`` has ``(source, size, n, words, mean, target)``, a row for each size in a source.  A
    document of the least size is weighed least, so the multiplier at which it alone would reach
    the target's share is one end of the bracket, and 0 the other.
    """
    one = W.partitionBy("source")
    goal, weight = F.col("target"), F.col("n") * F.col("size")
    full, none = goal >= cap * F.col("words"), (F.col("words") == 0) | (goal <= 0)
    share = F.when(none | full, 0.0).otherwise(F.log(goal / F.nullif("words", F.lit(0))))
    end = share * F.col("mean") / F.min(F.when(F.col("size") > 0, F.col("size"))).over(one)
    h = sizes.withColumn("_end", F.coalesce(end, F.lit(0.0)) * 1.001)
    h = h.withColumns({"a": share, "low": F.least("_end", F.lit(0.0)), "high": F.greatest("_end", F.lit(0.0))}).drop("_end")
    expected = F.sum(weight * _rate(F.col("a"), F.col("size"), F.col("mean"), cap)).over(one)
    for _ in range(_JOBS):
        for _ in range(_ROUNDS):
            w = _rate(F.col("a"), F.col("size"), F.col("mean"), cap)
            slope = F.when(w < cap, weight * w * F.col("size") / F.col("mean")).otherwise(0.0)
            h = h.withColumns({"g": expected, "d": F.sum(slope).over(one)})
            h = h.withColumns({"low": F.when(F.col("g") < goal, F.col("a")).otherwise(F.col("low")), "high": F.when(F.col("g") >= goal, F.col("a")).otherwise(F.col("high"))})
            newton = F.col("a") + (goal - F.col("g")) / F.nullif("d", F.lit(0.0))
            inside = (newton > F.col("low")) & (newton < F.col("high"))
            h = h.withColumn("a", F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)).drop("g", "d")
        h = written(h, "multipliers")
        off = h.withColumn("g", expected).where(~none & ~full).agg(F.max(F.abs(F.col("g") / goal - 1))).first()[0]
        if off is None or off <= RESIDUAL:
            break
    else:
        raise ValueError(f"the rates of a source are off its target by a share of {off:.3g}")
    h = h.withColumn("a", F.when(none, 0.0).when(full, 1e9).otherwise(F.col("a")))
    whole = F.when(none, 0).otherwise(F.floor(_rate(F.col("a"), F.col("size"), F.col("mean"), cap)) * weight)
    return h.groupBy("source").agg(F.max("a").alias("a"), F.sum(whole).alias("whole"))


def _with(rows: DataFrame, sources: DataFrame, key: str = "source") -> DataFrame:
    """``rows`` with their source's row of ``sources`` (a written table keyed by ``_of``)."""
    side = F.broadcast(sources) if sources.count() <= _BROADCAST_SOURCES else sources
    return rows.join(side, F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of")


def _place(rate: Column, key: Column, text_hash: Column) -> Column:
    """A document's place in its source's order of rounding: (hash over the fraction of its rate, hash of the text, id); null without a fraction."""
    u = (F.xxhash64(key, text_hash, F.lit(20240229)).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)
    fraction = rate - F.floor(rate)
    return F.when(fraction > 0, F.struct((u / fraction).alias("at"), text_hash.alias("th"), key.alias("id")))


def _cut(rows: DataFrame) -> DataFrame:
    """``(_of, cut, part)``: in each source, documents up to the place ``cut`` are rounded up, and of those at ``part`` = (place, up, m) only some.

    ``rows`` has ``(source, goal, size, place)``.  A source whose fractions all fit has no row.
    """
    first = F.floor(F.least(F.col("place.at") * 64, F.lit(_LEVELS - 1.0)))
    second = F.floor(F.least((F.col("place.at") * 64 - F.col("first")) * _LEVELS, F.lit(_LEVELS - 1.0)))

    def level_of(level: str, done) -> DataFrame:
        run = W.partitionBy("source").orderBy(level)
        sums = at.groupBy("source", level).agg(F.sum("size").alias("words"), F.max("goal").alias("goal"), F.max(done).alias("done"))
        sums = sums.withColumn("upto", F.col("done") + F.sum("words").over(run)).where(F.col("upto") >= F.col("goal"))
        found = sums.groupBy("source").agg(F.min(F.struct(level, (F.col("upto") - F.col("words")).alias("done"))).alias("p"))
        return written(found.select(F.col("source").alias("_of"), F.col("p")[level].alias(f"at_{level}"), F.col("p.done").alias("done")), level)

    at = rows.withColumn("first", first)
    one = level_of("first", F.lit(0.0))
    at = _with(at, one).where(F.col("first") == F.col("at_first")).withColumn("second", second)
    two = level_of("second", F.col("done"))
    floor = _with(one.select(F.col("_of").alias("source"), "at_first"), two).withColumn("low", (F.col("at_first") + F.col("at_second") / _LEVELS) / 64)
    at = _with(at.drop("done"), two).where(F.col("second") == F.col("at_second"))
    places = at.groupBy("source", "place").agg(F.count("*").alias("m"), F.max("size").alias("size"), F.max("goal").alias("goal"), F.max("done").alias("done"))
    before = F.coalesce(F.sum(F.col("m") * F.col("size")).over(W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fit = F.floor((F.col("goal") - F.col("done") - before) / F.col("size") + 0.5)
    places = places.withColumn("up", F.least(F.greatest(fit, F.lit(0)), F.col("m")))
    last = places.groupBy("source").agg(F.max(F.when(F.col("up") == F.col("m"), F.col("place"))).alias("last"), F.min(F.when((F.col("up") > 0) & (F.col("up") < F.col("m")), F.struct("place", "up", "m"))).alias("part"))
    none = lambda c: F.lit(None).cast(rows.schema["place"].dataType[c].dataType)
    lowest = F.struct(F.col("low").alias("at"), none("th").alias("th"), none("id").alias("id"))
    cut = floor.join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return written(cut.select(F.col("source").alias("_of"), F.coalesce("last", lowest).alias("cut"), "part"), "cut")


def _up(place: Column) -> Column:
    """1 if the cut of its source rounds a document up, whatever its other rows at the same place do."""
    return F.coalesce(F.when(place.isNull(), 0).when(F.col("cut").isNull(), 1).otherwise((place <= F.col("cut")).cast("int")), F.lit(0))


def _turned(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``(_of, cut, part, turns)``: and the places at which one document is rounded the other way, which brings the source nearer to its target.

    ``part`` and each of ``turns`` are (place, up, m): so many of the m documents at the place are
    rounded up.  One document after another is turned, the one that brings its source nearest; that
    is tried from the cut and from the cut with the next document taken, which a source with a few
    very long documents needs, and the nearer end counts.
    """
    rounded = _with(rows, cut).withColumn("up", _up(F.col("place")))
    in_part = F.coalesce(F.col("place") == F.col("part.place"), F.lit(False))
    free = F.when(~in_part, F.struct("place", "up", "size"))
    sums = rounded.groupBy("source").agg(
        (F.max("goal") - F.sum(F.when(in_part, 0).otherwise(F.col("up")) * F.col("size")) - F.coalesce(F.max(F.when(in_part, F.col("size") * F.col("part.up"))), F.lit(0))).alias("left"),
        F.min(F.when(F.col("up") == 0, free)).alias("next"), (F.max("target") * _NEAR).alias("enough"),
    )
    turn = lambda c: F.struct(F.col(f"{c}.place").alias("place"), F.col(f"{c}.up").alias("up"))
    none = F.array(turn("next")).alias("turns")
    ways = F.array(F.struct(F.lit(0).alias("way"), "left", F.slice(none, 1, 0).alias("turns")), F.struct(F.lit(1).alias("way"), (F.col("left") - F.col("next.size")).alias("left"), none))
    ways = sums.withColumn("off", F.abs("left")).select("source", "off", "enough", F.explode(ways).alias("w"))
    state = written(ways.where("w.way = 0 OR off > enough").select(F.col("source").alias("_of"), "enough", "w.*").where("left IS NOT NULL"), "ways")
    rows_free = rounded.where(~in_part).select("source", "place", "up", "size")
    change = lambda c: F.when(F.col(f"{c}.up") == 1, -F.col(f"{c}.size")).otherwise(F.col(f"{c}.size"))
    for _ in range(_TURNS):
        off = F.abs(F.col("left") - change("r"))
        tried = _with(rows_free.select("source", F.struct("place", "up", "size").alias("r")), state).where((F.abs("left") > F.col("enough")) & (off < F.abs("left")) & ~F.exists("turns", lambda t: t["place"] == F.col("r.place")))
        best = tried.groupBy("source", "way").agg(F.min(F.struct(off.alias("off"), "r"))["r"].alias("r")).withColumnRenamed("way", "_way")
        best = written(best, "best")
        if best.isEmpty():
            break
        after = state.join(best, F.col("_of").eqNullSafe(F.col("source")) & (F.col("way") == F.col("_way")), "left")
        left = F.when(F.col("r").isNull(), F.col("left")).otherwise(F.col("left") - change("r"))
        state = written(after.select("_of", "enough", "way", left.alias("left"), F.when(F.col("r").isNull(), F.col("turns")).otherwise(F.concat("turns", F.array(turn("r")))).alias("turns")), "ways")
    chosen = written(state.groupBy("_of").agg(F.min(F.struct(F.abs("left").alias("off"), "way", "turns"))["turns"].alias("turns")), "chosen")
    at = _with(rows.select("source", "place"), chosen).withColumn("t", F.get(F.filter("turns", lambda t: t["place"] == F.col("place")), 0)).where("t IS NOT NULL")
    at = at.groupBy("source", "t").agg(F.count("*").alias("m"))
    new = F.struct(F.col("t.place").alias("place"), F.when(F.col("t.up") == 1, F.col("m") - 1).otherwise(F.lit(1).cast("long")).alias("up"), "m").cast(cut.schema["part"].dataType)
    turns = at.groupBy("source").agg(F.collect_list(new).alias("turns"))  # _TURNS and one at most
    both = turns.join(cut, F.col("source").eqNullSafe(F.col("_of")), "full_outer")
    return written(both.select(F.coalesce("source", "_of").alias("_of"), "cut", "part", "turns"), "rounding")


def balanced_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (its source's), ``rate``, ``copies`` and ``taken``, which replace columns of the same name."""
    own = {"_id": id_col, "_text": text_col, "_source": source_col}
    text_hash = F.xxhash64(F.col("_text").cast("string"))
    with interim(docs.sparkSession) as keep:
        narrow = packed(docs, **own).select(F.col("_id").alias("id"), text_hash.alias("th"), F.col("_source").alias("source"), word_count(F.col("_text")).alias("size"))
        narrow = written(narrow, "narrow")
        sizes = written(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
        sources = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs"))
        sources = targets(sources, share, cap, weights).withColumn("mean", F.greatest(F.col("words") / F.col("docs"), F.lit(1e-9)))
        sources = written(sources.select(F.col("source").alias("_of"), "words", "mean", "target"), "sources")
        solved = _multipliers(_with(sizes, sources), cap).withColumnRenamed("source", "_s")
        known = sources.join(solved, F.col("_of").eqNullSafe(F.col("_s"))).select("_of", "words", "mean", "target", "a", (F.col("target") - F.col("whole")).alias("goal"))
        known = keep(written(known, "known"))
        rate = F.when(F.col("target") > 0, _rate(F.col("a"), F.col("size"), F.col("mean"), cap)).otherwise(0.0)
        rows = _with(narrow, known).where("size > 0").withColumn("place", _place(rate, F.col("id"), F.col("th"))).where("place IS NOT NULL")
        rows = rows.select("source", "goal", "target", "size", "place")
        rounding = keep(_turned(rows, _cut(rows)))

    mixed = packed(docs, **own).withColumn("size", word_count(F.col("_text")))
    mixed = _with(_with(mixed, known, "_source"), rounding, "_source").withColumn("rate", rate)
    mixed = mixed.withColumn("_at", F.when(F.col("size") > 0, _place(F.col("rate"), F.col("_id"), text_hash)))
    here = lambda c: F.coalesce(F.col("_at") == F.col(f"{c}.place"), F.lit(False))
    mixed = mixed.withColumn("turn", F.get(F.filter("turns", lambda t: t["place"] == F.col("_at")), 0))
    of_place = F.when(here("part"), F.col("part")).when(F.col("turn").isNotNull(), F.col("turn"))
    if rounding.where("part.m > 1 OR exists(turns, t -> t.m > 1)").isEmpty():
        mixed = mixed.withColumn("_up", F.when(F.col("turn").isNotNull(), F.col("turn.up")).otherwise(_up(F.col("_at"))))
    else:  # some source is cut or turned among equal rows: those alone are numbered
        mixed = mixed.withColumn("_special", of_place)
        among = F.row_number().over(W.partitionBy("_source", "_at").orderBy(F.xxhash64("_row"))) <= F.col("_special.up")
        special = mixed.where("_special IS NOT NULL").withColumn("_up", among.cast("long"))
        mixed = mixed.where("_special IS NULL").withColumn("_up", _up(F.col("_at")).cast("long")).unionByName(special)
    mixed = mixed.withColumn("copies", (F.floor("rate") + F.col("_up")).cast("long"))
    mixed = mixed.withColumn("copies", F.when((F.col("size") == 0) & (F.col("target") > 0), F.lit(1).cast("long")).otherwise(F.col("copies")))
    mixed = mixed.withColumn("taken", F.col("copies") * F.col("size")).withColumn("source_size", F.col("words").cast("long"))
    return unpacked(mixed, docs, own, "size", "source_size", "target", "rate", "copies", "taken")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: every document row as often as it is taken, numbered by ``copy`` from 1."""
    mixed = balanced_mix(docs, id_col, text_col, source_col, **how)
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return mixed.where("copies > 0").select(*[F.col(quoted(c)) for c in mixed.columns], copy)
