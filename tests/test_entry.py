"""Driver contract: entry() runs; a few catalog queries equal their DuckDB oracle at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from dialsift.sources.tables import TABLES

from .conftest import SF001


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 15 and set(df.columns) == {"estrategia", "hito", "llamadas", "porcentaje_dataset"}


def test_every_oracle_key_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["milestones", "feature_all", "stratified_split", "knn_exact", "select_best",
                                  "correlation_prune", "smote"])
def test_oracle_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    s = E.queries()[name](spark, SF001).toPandas()
    o = con.execute(E.oracle_sql()[name]).df()
    cols = sorted(s.columns)
    assert cols == sorted(o.columns)
    key = lambda t: tuple((x is None, str(x)) for x in t)
    srows = sorted((tuple(_norm(x) for x in r) for r in s[cols].itertuples(index=False)), key=key)
    orows = sorted((tuple(_norm(x) for x in r) for r in o[cols].itertuples(index=False)), key=key)
    assert srows == orows
