"""Spark query == independent DuckDB SQL on the sf0.001 tables (row count, columns, value hash)."""

import os

import duckdb
import pytest

from tests.conftest import SF001
from tools.oracle_check import TABLES, digest

def _oracle_names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


NAMES = _oracle_names()   # every query that has an SQL oracle


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF001, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF001)
    rel = duck.sql(E.oracle_sql()[name])
    srows, drows = [tuple(r) for r in sdf.collect()], rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert digest(srows, sdf.columns)[0] == digest(drows, rel.columns)[0]


def test_every_query_has_oracle_or_is_rows_only():
    import __spark_entry__ as E
    from acurail.plans.queries import QUERIES
    rows_only = set(QUERIES) - set(E.oracle_sql())
    assert rows_only <= {"train_lr", "train_rf", "train_gbt", "train_softmax",
                         "model_selection", "feature_importance", "score_batch", "train_pipeline"}


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 1000
    assert "predicted_acuity" in df.columns
