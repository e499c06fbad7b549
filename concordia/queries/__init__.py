"""Registered queries: name -> (Spark function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> dict[str, tuple[Query, str | None]]:
    from concordia.queries import catalog, changes, chunks, guarantees, jobs, sources, state, values, verify

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (verify, chunks, values, changes, state, catalog, sources, jobs, guarantees):
        out |= module.QUERIES
    return out
