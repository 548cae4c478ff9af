"""Queries against their SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

from tidewatch.oracles import ORACLE_SQL
from tidewatch.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if pd.isna(v):
            return None
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)[:10] if hasattr(v, "year") else v if isinstance(v, str) else bool(v) if str(v) in ("True", "False") else round(float(v), 9)
        return round(float(v), 9)

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", ORACLE_SQL)
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_sql(spark, sf_dir, name):
    want, got = connected(sf_dir).sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)


@pytest.mark.parametrize("name", ["link_extraction", "normal_forms", "message_types", "tactic_table", "normalized_messages", "knowledge_tables", "threshold_robust"])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
