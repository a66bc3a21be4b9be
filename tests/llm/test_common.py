import pytest

from rasterweave.llm.common import joined


@pytest.mark.parametrize("limit", [0, 100])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_joined(spark, limit, how):
    left = spark.createDataFrame([(i % 3 or None, "x", i) for i in range(30)] + [(9, None, 99)], "k int, s string, v int")
    right = spark.createDataFrame([(None, "x", 10), (1, "x", 20), (9, None, 30), (2, "y", 40)], "k int, t string, w int")
    got = joined(left, right, [("k", "k"), ("s", "t")], how, limit=limit)
    assert got.columns == ["k", "s", "v", "w"]
    want = {(None, "x"): 10, (1, "x"): 20, (9, None): 30}
    rows = got.collect()
    assert len(rows) == (31 if how == "left" else 21)
    assert all(r.w == want.get((r.k, r.s)) for r in rows)
