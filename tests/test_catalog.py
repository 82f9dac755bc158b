"""Every registered query against its SQL, on the smallest generated tables."""

import math

import duckdb
import pytest

from spanforge import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert ours
        return
    found = sql.sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    """Theta joins became equalities, top-k is pruned before its shuffle, filters reach the scan."""

    def plan(name):
        return catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()

    for name in ("stem_importers", "symbol_importers", "impact_radius"):
        assert "Cartesian" not in plan(name) and "module#" in plan(name)
    assert "WindowGroupLimit" in plan("vector_topk_batch")
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1)" in plan("define_edges")
