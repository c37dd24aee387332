"""Every registered query of the library gives the rows of its SQL on the smallest tables."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from stemma.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def normal(df):
    columns = sorted(df.columns)
    df = df[columns].copy()
    for c in columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
        elif pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_its_sql(spark, con, name):
    pd.testing.assert_frame_equal(normal(registry.QUERIES[name](spark, FOLDER).toPandas()), normal(con.sql(registry.ORACLE_SQL[name]).df()), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_distances_of_matches_with_unknown_residues_equal_the_sql(spark, tmp_path):
    schema = spark.read.parquet(f"{FOLDER}/lineitem.parquet").schema
    item = lambda order, number, part, supp, flag: (order, part, supp, number, 1.0, 1.0, 0.0, 0.0, flag, "O", datetime.datetime(2020, 1, 1 + number))
    rows = [item(1, 0, None, 5, "A"), item(1, 1, 3, None, "A"), item(2, 0, 1, 1, "N"), *(item(3, k, None if k < 3 else k, 5, "A") for k in range(7)), item(4, 0, 7, 7, "A"), item(4, 1, None, 2, "R")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("customer", "documents", "nation", "orders", "region"):
        con.execute(f"CREATE VIEW {name} AS FROM '{FOLDER}/{name}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(map(tuple, registry.QUERIES["pair_distances"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(registry.ORACLE_SQL["pair_distances"]).fetchall())
    assert (1, 2, None, None, float("inf"), None) in got


def test_rates_of_columns_with_one_leaf_equal_the_sql(spark, tmp_path):
    """They tie but for the last bits, which decide the likeliest one."""
    schema = spark.read.parquet(f"{FOLDER}/lineitem.parquet").schema
    item = lambda order, number: (order, 1, 1, number, 1.0, 1.0, 0.0, 0.0, "ANR"[number % 3], "O", datetime.datetime(2020, 1, 1))
    rows = [item(o, k) for o, n in ((1, 2), (2, 3), (130, 9), (10**6, 12)) for k in range(n)]  # the last one is in no tree
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("customer", "documents", "nation", "orders", "region"):
        os.symlink(f"{FOLDER}/{name}.parquet", f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS FROM '{FOLDER}/{name}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = registry.QUERIES["column_rate_posteriors"](spark, str(tmp_path)).toPandas()
    pd.testing.assert_frame_equal(normal(got), normal(con.sql(registry.ORACLE_SQL["column_rate_posteriors"]).df()), check_dtype=False)
    assert sorted(set(got[got["col"] > 2]["likeliest"])) == [1, 3]


def test_distances_equal_the_sql_to_the_sign_of_zero(spark, tmp_path):
    schema = spark.read.parquet(f"{FOLDER}/lineitem.parquet").schema
    item = lambda order, number, supp: (order, 7, supp, number, 1.0, 1.0, 0.0, 0.0, "A", "O", datetime.datetime(2020, 1, 1 + number))
    rows = [item(o, k, 7 if k < same else 8) for o, (n, same) in enumerate([(1, 1), (1, 0), (6, 6), (6, 4), (20, 20), (20, 1)]) for k in range(n)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("customer", "documents", "nation", "orders", "region"):
        con.execute(f"CREATE VIEW {name} AS FROM '{FOLDER}/{name}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(map(tuple, registry.QUERIES["pair_distances"](spark, str(tmp_path)).collect()))
    assert [list(map(repr, r)) for r in got] == [list(map(repr, r)) for r in sorted(con.sql(registry.ORACLE_SQL["pair_distances"]).fetchall())]
    assert repr(got[2][3]) == repr(got[2][4]) == "-0.0"
