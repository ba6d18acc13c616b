"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from oddsloom.plans import catalog, catalog_auto, catalog_contracts, catalog_identity, catalog_model, catalog_monitor, catalog_more, catalog_payload, catalog_recovery, catalog_state, catalog_traps  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(SF).iterdir():
        con.execute(f"create view {p.name.split('.')[0]} as select * from '{p}'")
    return con


def rows(frame: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    found, wanted = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) > 0
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_share_search_by_brute_force(spark):
    from oddsloom.operators import model
    from oddsloom.plans.adapters import rates

    poisson = lambda rate: [math.exp(-rate) * rate**g / math.factorial(g) for g in range(13)]
    base = rates(spark, SF).limit(3)
    targets = base.selectExpr("match_id", "0.45D as t_home", "0.25D as t_draw", "0.30D as t_away")
    found = {r["match_id"]: r["share"] for r in model.share_search(base, targets).collect()}
    for r in base.collect():
        total, best = r["lh"] + r["la"], None
        for k in range(151, 850):
            h, a = poisson(total * k / 1000), poisson(total * (1 - k / 1000))
            mass = sum(h) * sum(a)
            win = sum(x * y for i, x in enumerate(h) for j, y in enumerate(a) if i > j) / mass
            draw = sum(x * y for i, x in enumerate(h) for j, y in enumerate(a) if i == j) / mass
            error = round((win - 0.45) ** 2 + (draw - 0.25) ** 2 + (1 - win - draw - 0.30) ** 2, 9)
            best = min(best or (error, k), (error, k))
        assert found[r["match_id"]] == best[1] / 1000
