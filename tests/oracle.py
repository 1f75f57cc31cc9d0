"""Compare a query with its SQL twin on the same parquet files."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    expected = canonical(names, relation.fetchall())
    if got[0] != expected[0]:
        return f"columns {got[0]} vs {expected[0]}"
    if len(got[1]) != len(expected[1]):
        return f"{len(got[1])} rows vs {len(expected[1])}"
    wrong = [(a, b) for a, b in zip(got[1], expected[1]) if a != b]
    return f"{len(wrong)} rows differ, e.g. {str(wrong[0])[:600]}" if wrong else None
