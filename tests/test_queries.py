"""Every query with SQL against DuckDB, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from riskweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df, columns):
    def plain(v):
        if v is None or v != v:
            return None
        return round(float(v), 7) if isinstance(v, float) else v if isinstance(v, str) else int(v) if float(v).is_integer() else round(float(v), 7)

    return Counter(tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, con, name):
    want = con.execute(registry.oracle_sql()[name]).fetchdf()
    got = registry.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"scored_transactions"}))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
