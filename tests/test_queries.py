"""Each registered query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
from pathlib import Path

import duckdb
import pytest

from corpusloom import plans


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if hasattr(x, "tolist"):
        x = x.tolist()
    return str([plain(y) for y in x]) if isinstance(x, list) else str(x)


def rows(pdf) -> list:
    return sorted(tuple(plain(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    got, want = plans.queries()[name](spark, sf).toPandas(), duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0
