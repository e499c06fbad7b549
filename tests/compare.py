"""A query's rows against DuckDB's for its SQL, over the smallest test tables."""

import os

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def differences(spark, con, query, sql) -> str | None:
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in rel.fetchall())
    return None if got == want else f"{len(got)} and {len(want)} rows; only here {sorted(set(got) - set(want))[:2]}, only there {sorted(set(want) - set(got))[:2]}"


def available() -> bool:
    return os.path.isdir(DATA)
