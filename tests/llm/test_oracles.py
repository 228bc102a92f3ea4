"""The operators' own SQL, run by DuckDB over the same tables."""

import duckdb
import pandas as pd
import pytest

from freshet.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.execute(oracles.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want) > 0
    by = [c for c in ("doc_id", "page_id", "conv_id", "depth") if c in cols]
    order = lambda df: df[cols].astype(object).where(df[cols].notna(), None).sort_values(by).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
