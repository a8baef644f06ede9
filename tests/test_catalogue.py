"""Every query of the catalogue runs at the smallest scale; those with SQL give the same rows as the SQL."""

import glob
import os

import pytest

import __spark_entry__ as entry
from docspark.plans import catalogue

DATA = "/root/testdata/sf0.001"


def norm(x):
    if isinstance(x, float):
        return None if x != x else int(x) if x == int(x) else round(x, 6)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([norm(y) for y in x])
    return None if x is None or x != x else x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def same(spark, duck, f, sql):
    a = f(spark, DATA).toPandas()
    b = duck.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted(repr(tuple(map(norm, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    if name in catalogue.SQL:
        same(spark, duck, catalogue.QUERIES[name], catalogue.SQL[name])
    else:
        assert name == "q09_static_filter"
        rows = catalogue.QUERIES[name](spark, DATA).toPandas()
        pages = duck.execute("SELECT seq, raw_text FROM source_document WHERE contains(lower(media_type), 'html')").df()
        both = rows.merge(pages, on="seq")
        assert len(rows) == len(both) == len(pages)
        # what the filter gives is a part of the page, with a heading of its own at most
        kept = both[both.raw_text.notna()]
        assert (kept.markup.str.len() <= kept.raw_text.str.len() + 200).all() and (kept.markup != kept.raw_text).any()


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
