"""Every query runs at the smallest scale; those with SQL give the same rows."""

import glob
import os

import pytest

from docspark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    if name not in queries.SQL:
        rows = df.toPandas()
        assert len(rows) and not rows.drop_duplicates([c for c in rows.columns if not rows[c].map(lambda x: hasattr(x, "__len__") and not isinstance(x, str)).any()]).empty
        if name.endswith("_found"):
            assert not rows.duplicated().any()
        return
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = c.execute(queries.SQL[name]).df()
    got = df.toPandas()[list(want.columns)]
    rows = lambda x: sorted(map(repr, x.itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
