"""The queries of the subpackage that SQL can express, against DuckDB on whole tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from ionlake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    text = lambda x: "" if pd.isna(x) else str(x) if isinstance(x, (bool, np.bool_, str)) else repr(float(x))
    rows = lambda frame: sorted(tuple(map(text, r)) for r in frame[columns].astype(object).itertuples(index=False))
    assert sorted(got.columns) == columns and rows(got) == rows(want)
