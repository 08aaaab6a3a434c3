"""Compares a query's rows with its SQL's, whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}" if value else "0"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value) if not isinstance(value, int) else f"{value}"


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, want = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = [tuple(plain(r[n]) for n in order) for r in df.collect()]
    want = [tuple(plain(r[names.index(n)]) for n in order) for r in want]
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(sorted(got), sorted(want), strict=True) if a != b]
    different = [(a, b) for a, b in different if not all(x == y or (_number(x) is not None and _number(y) is not None and math.isclose(_number(x), _number(y), rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b, strict=True))]
    assert not different, different[:3]


def _number(x):
    try:
        return float(x)
    except ValueError:
        return None
