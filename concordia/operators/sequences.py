"""Identity and sequence values at the switch (AGG10, MSC6, MUT10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_value(last: Column, seed: Column, increment: Column, target_end: Column) -> Column:
    """MSC6: one step after the source's last value, or after the target's furthest one if that is ahead; the seed if never used.

    ``target_end`` is the greatest value present, the least for a falling sequence.
    """
    base = F.when(last.isNull(), seed).otherwise(last + increment)
    ahead = F.when(increment > 0, target_end >= base).otherwise(target_end <= base)
    return F.when(target_end.isNotNull() & ahead, target_end + increment).otherwise(base)


def target_ends(df: DataFrame, column: str, increment: int = 1) -> DataFrame:
    """AGG10."""
    return df.agg((F.max(column) if increment > 0 else F.min(column)).alias("target_end"))


def set_values(state: DataFrame, chosen: DataFrame) -> DataFrame:
    """MUT10: the sequence state with the chosen values; doing it again changes nothing."""
    new = chosen.select("sequence", F.col("next_value").alias("_v"))
    rows = state.join(new, "sequence", "full_outer")
    return rows.select("sequence", F.coalesce("_v", "value").alias("value"), F.when(F.col("_v").isNotNull(), False).otherwise(F.col("is_called")).alias("is_called"))
