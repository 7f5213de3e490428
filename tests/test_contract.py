"""Every registered query with SQL agrees with it on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from wavemill.plans import registry

DATA = "/root/testdata/sf0.001"
#: Findings that the smallest tables need not hold.
MAY_BE_EMPTY = {"resampling_finding", "imaging_nulls", "downsampling_rolloff", "upsampling_shelf"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def canonical(df):
    out = pd.DataFrame(index=df.index)
    for c in sorted(df.columns):
        s = df[c]
        numeric = s.dtype.kind in "fiub" or str(s.dtype).lower().startswith(("int", "float", "bool"))
        out[c] = s.astype(float) if numeric and s.dtype.kind != "b" else s
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = canonical(registry.queries()[name](spark, DATA).toPandas()), canonical(duck.sql(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert len(got) or name in MAY_BE_EMPTY
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c].astype(float), atol=2e-4, equal_nan=True), c
        else:
            assert (got[c].fillna("") == want[c].fillna("")).all(), c


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_names_and_sql_need_no_session():
    """The driver lists queries and SQL before it starts Spark."""
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) < set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)
