"""Every evidence query against its oracle at the smallest scale, where the tables are at hand."""

import math
from pathlib import Path

import duckdb
import pytest

from corrobora.plans import catalogue

SF = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_is_its_oracle(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = catalogue.QUERIES[name](spark, str(SF))
    want = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(plain(list(r))) for r in df.select(*columns).collect()) == sorted(str(plain(list(r))) for r in want.fetchall())
