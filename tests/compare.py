from __future__ import annotations


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(data) -> list:
    return sorted((tuple(plain(x) for x in r) for r in data), key=repr)


def assert_same(df, duck, sql: str) -> None:
    """The frame's rows and columns equal the DuckDB statement's, whatever the order."""
    relation = duck.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    names = list(relation.columns)
    assert rows(df.select(*names).collect()) == rows(relation.fetchall())
