"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from trovex.catalogue import QUERIES, SQL


def comparable(rows: list[dict]) -> list[tuple]:
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple((k, plain(r[k])) for k in sorted(r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert comparable(rows) == comparable([dict(zip(columns, r, strict=True)) for r in found.fetchall()])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "title", "plugin_id", "rank_score"]
