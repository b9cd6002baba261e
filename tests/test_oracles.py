"""Fitted rain and monthly corrections against their SQL, row by row."""

import os
from pathlib import Path

import duckdb
import pytest

from isobar import registry, registry_models  # noqa: F401

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", ["bc_eqm_precip", "bc_ptr", "isimip_precip", "isimip_multiplicative"])
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    got, want = registry._QUERIES[name](spark, str(DATA)).toPandas(), con.execute(registry._SQL[name]).df()
    for side in (got, want):
        side["t"] = side["t"].astype(str).str[:10]
    both = got.merge(want, on=["loc_id", "t"], suffixes=("", "_sql"))
    assert len(got) == len(want) == len(both) > 0
    assert ((both["corrected"] - both["corrected_sql"]).abs() < 1e-9).all()
