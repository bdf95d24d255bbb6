"""The driver's entry points, and some queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from cumulo import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() == 8


def test_registries_agree():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


FAST = ("norm_l2", "norm_zscore", "weight_idf", "init_random_membership", "kmeanspp_membership", "filter_counts", "category_counts", "synthetic_bands", "silhouette_per_cluster", "top_var_features")


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[cols].astype(str).values))
    assert rows(got) == rows(want)
