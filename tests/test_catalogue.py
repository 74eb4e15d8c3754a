import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def value(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    rows = lambda df: sorted((tuple(value(v.item() if hasattr(v, "item") else v) for v in r) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False)), key=str)
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    if name not in catalogue.SQL:
        # without SQL: the same rows in any partitioning
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        try:
            again = catalogue.QUERIES[name](spark, SMALL).toPandas()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(got) > 0 and rows(got) == rows(again)
        return
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(catalogue.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SMALL):
        assert entry.entry(spark).count() > 0
