"""Comparison of a Spark result with a DuckDB query on the same tables."""

import math
import pathlib

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings wiki_item posting_batch term_meta_temp query_log watch_term"


def connect(folder):
    con = duckdb.connect()
    for name in TABLES.split():
        path = pathlib.Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, result.fetchall())
