"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from rasterweave.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = ["flagship_indices", "p7_ndvi", "p9_ndvi_null", "a2_band_stats", "a6_otsu", "n5_gaussian_blur", "n7_sobel", "n18_closing", "i3_label", "a12_glcm", "d2_fast", "s1_read_raster_round_trip"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert cells([tuple(r) for r in got.collect()], got.columns) == cells(want.fetchall(), names)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
