"""Every query of the reference's operators against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tabulon import plans

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if not isinstance(v, (list, dict)) and pd.isna(v):
            return "NULL"
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, db, name):
    got = plans.QUERIES[name](spark, DIR)
    kinds = dict(got.dtypes)
    got = got.toPandas()
    assert name in plans.ORACLE
    want = db.sql(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c, kind in kinds.items():
        for f in (got, want):
            if kind in ("int", "bigint") and f[c].dtype.kind == "f":
                f[c] = f[c].astype("Int64")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitions_make_no_difference(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = {n: rows(plans.QUERIES[n](spark, DIR).toPandas()) for n in ("bands", "formula_families", "snapshot_diff")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for n, w in want.items():
            assert rows(plans.QUERIES[n](spark, DIR).toPandas()) == w
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
