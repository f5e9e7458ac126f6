"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from scriptorium.plans.families import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)
    else:
        assert columns


def test_plans_prune_and_stay_native(spark):
    plan = QUERIES["page_title_blocks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "url" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = QUERIES["first_n_per_group"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]
