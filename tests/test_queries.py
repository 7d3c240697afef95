"""Every query with an oracle gives DuckDB's rows on the smallest tables; the others give rows."""

import duckdb
import pytest

from tarnfold import plans
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()
SLOW = {"girvan_newman", "hybrid_model", "gbt_model", "logit_cv", "logit_ablation", "ridge_lasso_grid", "bfr", "kmeans_silhouette"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df, want = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
