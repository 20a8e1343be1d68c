import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal" else str(v)


def rows_of(pdf, columns):
    return sorted((tuple(map(plain, r)) for r in pdf[columns].astype(object).values.tolist()), key=repr)


@pytest.fixture
def same(spark, sf_dir, duck):
    def check(query, sql):
        a, b = query(spark, sf_dir).toPandas(), duck.execute(sql).fetch_df()
        assert sorted(a.columns) == sorted(b.columns)
        assert rows_of(a, sorted(a.columns)) == rows_of(b, sorted(a.columns))

    return check
