"""Rows of a query against its SQL in DuckDB."""

import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def normal(rows):
    def value(x):
        return round(x, 6) + 0.0 if isinstance(x, float) else x if isinstance(x, (int, str, type(None))) else str(x)

    return sorted((tuple(value(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(df, sql, con):
    cols = sorted(df.columns)
    names = sorted(r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall())
    assert cols == names
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert normal(tuple(r) for r in df.select(*cols).collect()) == normal(con.execute(f"SELECT {quoted} FROM ({sql})").fetchall())
