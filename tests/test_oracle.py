"""Every query with SQL gives the SQL's rows, on the smallest tables, and again when the input is dealt anew."""

import duckdb
import pandas as pd
import pytest

from plumbline.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    want = sql.execute(registry.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(normal(got), normal(want))


@pytest.mark.parametrize("name", ["dup_exact", "labels_conflict", "shortcut_single_feature", "psi", "group_split"])
def test_partitioning_changes_nothing(spark, monkeypatch, name):
    before = normal(registry.queries()[name](spark, FOLDER).toPandas())
    plain = registry.read_table
    monkeypatch.setattr(registry, "read_table", lambda s, d, t: plain(s, d, t).repartition(7))
    pd.testing.assert_frame_equal(normal(registry.queries()[name](spark, FOLDER).toPandas()), before)
