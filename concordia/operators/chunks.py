"""Key ranges of a table: the unit of parallel copying and of restart (CHK1-CHK4, WIN1-WIN2, FIL1)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Key types whose order and text form make them fit for ranges.
SPLITTABLE = frozenset("bigint int smallint tinyint decimal numeric date datetime datetime2 smalldatetime char varchar nchar nvarchar sysname".split())
INTEGERS = frozenset("bigint int smallint tinyint".split())


def even_starts(low: int, high: int, n: int) -> list[int]:
    """CHK1: where the second and later of n equal ranges of [low, high] start."""
    span, out = high - low + 1, []
    for i in range(1, n):
        at = low + span * i // n
        if low < at <= high and (not out or at > out[-1]):
            out.append(at)
    return out


def ranges(starts: Sequence) -> list[tuple]:
    """CHK2: half-open ranges; the first has no lower and the last no upper bound."""
    edges = [None, *starts, None]
    return list(zip(edges, edges[1:], strict=False))


def chunk_count(rows: int, rows_per_chunk: int, key_types: Sequence[str]) -> int:
    """CHK3: one chunk without a key, for an unfit key type, or for an empty table."""
    if not key_types or any(t not in SPLITTABLE for t in key_types) or rows <= 0:
        return 1
    return max(1, -(-rows // max(1, rows_per_chunk)))


def bound_text(value) -> str | None:
    """CHK4: a bound as text, and back by a cast to the key's type."""
    return None if value is None else str(value)


def bound_value(text: str | None, kind: str) -> Column:
    types = {"int": "int", "bigint": "bigint", "smallint": "smallint", "tinyint": "smallint", "date": "date", "decimal": "decimal(38,10)", "numeric": "decimal(38,10)"}
    types |= {t: "timestamp_ntz" for t in ("datetime", "datetime2", "smalldatetime")}
    return F.lit(text).cast(types.get(kind, "string"))


def even_split(df: DataFrame, key: str, n: int) -> DataFrame:
    """AGG5 with CHK1, CHK2 as one plan: ``(chunk_no, lower, upper)`` from the key's least and greatest value."""
    edge = df.agg(F.min(key).cast("decimal(38,0)").alias("lo"), F.max(key).cast("decimal(38,0)").alias("hi"))
    at = edge.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    start = F.floor(F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) * F.col("i") / n)).cast("bigint")
    at = at.withColumn("start", start).where((F.col("i") == 0) | (F.col("start") > F.col("lo")) & (F.col("start") <= F.col("hi"))).dropDuplicates(["start"])
    order = W.orderBy("start")  # n rows
    return at.select(
        (F.row_number().over(order) - 1).cast("bigint").alias("chunk_no"), F.when(F.lag("start").over(order).isNotNull(), F.col("start")).alias("lower"), F.lead("start").over(order).alias("upper")
    )


def ntile_starts(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """WIN1, WIN2: exact equal-count ranges: ``(nt, key...)``, the least key of each tile but the first.

    NTILE over a whole table would bring it to one task.  Tiles follow from row numbers, so keys
    are range-partitioned and sorted, each partition is counted, and only the rows at the tiles'
    first positions remain; nothing but counts per partition is gathered.
    """
    parts = df.select(*key).repartitionByRange(*[F.col(k) for k in key]).withColumn("_p", F.spark_partition_id())
    in_part = W.partitionBy("_p").orderBy(*key)
    numbered = parts.withColumn("_i", F.row_number().over(in_part))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(W.partitionBy()))
    at = numbered.join(F.broadcast(before), "_p")  # a row per partition
    pos, small, more = F.col("_before") + F.col("_i"), F.floor(F.col("_all") / n), F.col("_all") % n
    nt = F.when(pos <= more * (small + 1), F.floor((pos - 1) / (small + 1)) + 1).otherwise(F.floor((pos - 1 - more) / F.greatest(small, F.lit(1))) + 1)
    first = F.when(nt <= more + 1, (nt - 1) * (small + 1) + 1).otherwise((nt - 1) * small + more + 1)
    return at.where((pos == first) & (nt > 1)).select(nt.cast("int").alias("nt"), *key)


def in_range(key: Sequence[str], lower: Sequence | None, upper: Sequence | None) -> Column:
    """FIL1: lower <= key < upper in the order of the key's parts, spelled out so that it reaches the scan."""
    def beyond(bound: Sequence, inclusive: bool) -> Column:
        out = F.lit(False)
        for i in reversed(range(len(key))):
            c, v = F.col(key[i]), bound[i] if isinstance(bound[i], Column) else F.lit(bound[i])
            last = i == len(key) - 1
            here = (c >= v if inclusive else c > v) if last else c > v
            out = here if last else here | (c == v) & out
        return out

    cond = F.lit(True)
    if lower is not None:
        cond = beyond(lower, True)
    if upper is not None:
        below = ~beyond(upper, True) if len(key) > 1 else F.col(key[0]) < upper[0]
        cond = below if lower is None else cond & below
    return cond


#: Ranges whose starts every task gets as an array (a few megabytes at most); more of them take an as-of lookup.
MOST_STARTS = 1 << 16


def last_start(starts: Column, n: int, key: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """How many of the n sorted starts lie up to the key, by binary search; ``of`` takes the key out of an element."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, n.bit_length())))])
    fits = lambda at, step: (at + step <= n) & (of(F.get(starts, at + step - 1)) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def dealt(df: DataFrame, key: str, looks: int = 32) -> tuple[DataFrame, int]:
    """Every row with ``_part``, the number of its range of keys, and how many ranges there are: about as many as Spark has shuffle partitions.

    Where the ranges start is settled here, once, from a few of the keys, so a key has one number in
    all that is made of the result.  The number of a partition of ``repartitionByRange`` isn't such: each
    exchange draws keys of its own to range by, and two branches of a plan may get an exchange each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(key).where(F.col(key).isNotNull())
    rows = keys.count()
    drawn = keys.sample(min(1.0, parts * looks / rows), seed=1).distinct().collect() if rows else []  # some 32 keys for each range
    kind, step = df.schema[key].dataType.simpleString(), max(1, len(drawn) // parts)
    if len(drawn) < 2:
        return df.withColumn("_part", F.lit(0)), 1
    sample = df.sparkSession.createDataFrame([([r[0] for r in drawn],)], f"_s array<{kind}>")
    starts = sample.select(F.filter(F.sort_array("_s"), lambda _, i: i % step == step - 1).alias("_s"), F.lit(1).alias("_one"))
    n = len(drawn) // step
    found = df.withColumn("_one", F.lit(1)).join(F.broadcast(starts), "_one").withColumn("_part", F.coalesce(last_start(F.col("_s"), n, F.col(key)), F.lit(0)))  # a row
    return found.drop("_one", "_s"), n + 1


def chunk_counts(df: DataFrame, key: str, bounds: DataFrame, most: int = MOST_STARTS) -> DataFrame:
    """Rows in each range of ``bounds`` (a row per chunk; ranges meet end to start): ``(chunk_no, row_count)``; empty ranges count 0.

    A key's range is the one that starts last up to it.  It is found by binary search in the sorted
    starts, so rows are counted where they are read, and a row for each range and task is shuffled.
    """
    from concordia.operators.views import as_of  # which ranges keys by this module

    kind = df.schema[key].dataType
    starts = bounds.where("lower IS NOT NULL").select(F.col("lower").cast(kind).alias("lsn"), "chunk_no")
    keys = df.select(key).where(F.col(key).isNotNull())
    n = starts.count()
    if n <= most:
        every = starts.agg(F.sort_array(F.collect_list(F.struct("lsn", "chunk_no"))).alias("_s"))
        rows = keys.select(F.col(key).alias("k"), F.lit(1).alias("_one")).join(F.broadcast(every.withColumn("_one", F.lit(1))), "_one")  # a row
        place = last_start(F.col("_s"), n, F.col("k"), lambda x: x["lsn"])
        found = rows.select(F.get("_s", place - 1)["chunk_no"].alias("chunk_no"))
    else:
        found = as_of(keys, starts, key, value="chunk_no")
    first = F.when(F.col("lower").isNull(), F.lit(-1)).otherwise(F.col("chunk_no"))
    counts = found.groupBy(F.coalesce("chunk_no", F.lit(-1)).alias("_of")).agg(F.count("*").alias("row_count"))
    return bounds.select("chunk_no", first.alias("_of")).join(counts, "_of", "left").select("chunk_no", F.coalesce("row_count", F.lit(0)).alias("row_count"))


def range_sql(key: Sequence[str], kinds: Sequence[str], lower: Sequence[str] | None, upper: Sequence[str] | None, quote: str = '"') -> str:
    """FIL1 as the text of a condition, for databases: lower <= key < upper in the order of the key's parts; bounds are texts."""
    names = [f"{quote}{k}{quote}" for k in key]

    def value(text: str, kind: str) -> str:
        escaped = "'" + text.replace("'", "''") + "'"
        if kind in ("date",):
            return f"DATE {escaped}"
        if kind in ("datetime", "datetime2", "smalldatetime"):
            return f"TIMESTAMP {escaped}"
        return text if kind in INTEGERS or kind in ("decimal", "numeric") else escaped

    def beyond(bound: Sequence[str]) -> str:
        out = ""
        for c, v, kind in reversed(list(zip(names, bound, kinds, strict=True))):
            lit = value(v, kind)
            out = f"({c} > {lit} OR ({c} = {lit} AND {out}))" if out else f"{c} >= {lit}"
        return out

    parts = ([beyond(lower)] if lower is not None else []) + ([f"NOT {beyond(upper)}" if len(key) > 1 else f"{names[0]} < {value(upper[0], kinds[0])}"] if upper is not None else [])
    return " AND ".join(parts) or "1 = 1"
