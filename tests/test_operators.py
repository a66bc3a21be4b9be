"""Properties on drawn canvases, and small brute-force versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave import functions as pt
from rasterweave import operators as op
from rasterweave.operators import components, edges, neighborhood, stats
from rasterweave.operators.components import runs_labelled
from rasterweave.operators.keypoints import brief_pattern
from rasterweave.operators.segmentation import chamfer, flood


def frame(spark, a, image_id="a"):
    h, w = a.shape
    return spark.createDataFrame([(image_id, y, x, float(a[y, x])) for y in range(h) for x in range(w)], "image_id string, y int, x int, v double")


def back(df, column="v", kind=float):
    rows = df.select("y", "x", column).collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), kind)
    for r in rows:
        out[r.y, r.x] = r[column]
    return out


def correlate(a, k):
    r = len(k) // 2
    p = np.pad(a, r, mode="reflect")
    return sum(k[i][j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(len(k)) for j in range(len(k)))


@pytest.fixture(params=[256, 4])
def strip(request, monkeypatch):
    """Whole images in one strip, and many strips with halos."""
    monkeypatch.setattr(neighborhood, "STRIP", request.param)
    return request.param


@pytest.fixture
def noise():
    return np.random.default_rng(0).integers(0, 256, (17, 13)).astype(float)


def test_filters(spark, noise, strip):
    from rasterweave.operators.filters import gaussian_kernel

    df = frame(spark, noise)
    assert np.allclose(back(op.mean_blur(df, 5)), correlate(noise, np.full((5, 5), 1 / 25)))
    assert np.allclose(back(op.gaussian_blur(df, 7, 1.5)), correlate(noise, gaussian_kernel(7, 1.5)))
    p = np.pad(noise, 2, mode="reflect")
    want = [[np.median(p[y : y + 5, x : x + 5]) for x in range(13)] for y in range(17)]
    assert np.allclose(back(op.apply_filter(df, " MEDIAN", size=5)), want)


def test_small_images_reflect(spark):
    a = np.arange(12.0).reshape(3, 4)
    assert np.allclose(back(op.mean_blur(frame(spark, a), 5)), correlate(a, np.full((5, 5), 1 / 25)))
    assert np.allclose(back(op.mean_blur(frame(spark, np.full((1, 1), 7.0)), 3)), 7.0)


def test_parameters(spark, noise):
    df = frame(spark, noise)
    for bad in (2, 0, -1):
        with pytest.raises(ValueError):
            op.mean_blur(df, bad)
    with pytest.raises(TypeError):
        op.mean_blur(df, 3.0)
    for f in (lambda: op.gaussian_blur(df, 3, 0), lambda: op.apply_filter(df, "sharpen"), lambda: op.laplacian(df, 6), lambda: op.canny(df, 5, 5), lambda: op.glcm(df, angle=30), lambda: op.glcm(df, distance=0), lambda: op.texture_map(df, "x"), lambda: op.texture_map(df, window=4), lambda: op.erode(df, iterations=0), lambda: op.square(2), lambda: op.disk(0), lambda: op.fast_corners(df, n=17), lambda: pt.threshold("v", 300), lambda: pt.quantise("v", 0), lambda: op.kmeans(df, ["v"], 0)):
        with pytest.raises(ValueError):
            f()


def test_gradients(spark, noise, strip):
    kx, ky = edges.SOBEL
    gx, gy = correlate(noise, kx), correlate(noise, ky)
    m = np.sqrt(gx**2 + gy**2)
    got = op.sobel(frame(spark, noise))
    assert np.allclose(back(got), m / m.max() * 255)
    assert np.allclose(back(got, "direction"), np.degrees(np.arctan2(gy, gx)))
    flat = op.sobel(frame(spark, np.full((5, 5), 9.0)))
    assert back(flat).max() == 0


def test_canny_finds_a_square(spark, strip):
    a = np.zeros((40, 40))
    a[10:30, 10:30] = 200
    a = np.clip(a + np.random.default_rng(0).normal(0, 12, a.shape), 0, 255)
    e = back(op.canny(frame(spark, a), 40, 120, 1.4), "edge", bool)
    assert 20 < e.sum() < 400 and e[9:12, 12:28].any(0).all()


def brute_morph(m, element, op_name):
    h, w = m.shape
    cells = [(y - len(element) // 2, x - len(element[0]) // 2) for y, r in enumerate(element) for x, on in enumerate(r) if on]
    pick = all if op_name == "erode" else any
    return np.array([[pick(0 <= y + dy < h and 0 <= x + dx < w and m[y + dy, x + dx] for dy, dx in cells) for x in range(w)] for y in range(h)])


def test_morphology(spark, noise, strip):
    m = noise > 100
    df = frame(spark, noise).withColumn("fg", F.col("v") > 100)
    odd = [[True, False, False], [True, True, False], [False, False, False]]
    for e in (op.square(3), op.disk(2), op.cross(3), odd):
        assert (back(op.erode(df, e), "fg", bool) == brute_morph(m, e, "erode")).all()
        assert (back(op.dilate(df, e), "fg", bool) == brute_morph(m, e, "dilate")).all()
    opened = op.opening(df, op.cross(3))
    assert (back(op.opening(opened, op.cross(3)), "fg", bool) == back(opened, "fg", bool)).all()
    two = op.closing(df, iterations=2)
    want = m
    for step in ("dilate", "dilate", "erode", "erode"):
        want = brute_morph(want, op.square(3), step)
    assert (back(two, "fg", bool) == want).all()


def brute_labels(m):
    out, n = np.zeros(m.shape, int), 0
    for y, x in zip(*np.nonzero(m), strict=True):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            out[y, x] = n
            while todo:
                b, a = todo.pop()
                for v in range(max(0, b - 1), min(m.shape[0], b + 2)):
                    for u in range(max(0, a - 1), min(m.shape[1], a + 2)):
                        if m[v, u] and not out[v, u]:
                            out[v, u] = n
                            todo.append((v, u))
    return out


@pytest.mark.parametrize("rows, few", [(256, 50_000), (3, 50_000), (3, 0)])
@pytest.mark.parametrize("share", [0.0, 0.35, 1.0])
def test_components(spark, rows, few, share, monkeypatch):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    m = np.random.default_rng(3).random((20, 15)) < share
    df = frame(spark, m.astype(float)).withColumn("fg", F.col("v") > 0)
    got = op.labelled(df, strip=rows)
    assert (back(got, "label", int) == brute_labels(m)).all()
    y, x = np.nonzero(m)
    if len(y):
        assert len(set(runs_labelled(y, x))) == brute_labels(m).max()


def test_a_spiral_over_many_strips_is_one_component(spark):
    m = np.zeros((24, 24), bool)
    m[::2] = True
    m[1::4, -1] = True
    m[3::4, 0] = True
    df = frame(spark, m.astype(float)).withColumn("fg", F.col("v") > 0)
    assert (back(op.labelled(df, strip=2), "label", int) == brute_labels(m)).all()


def test_clean_mask(spark):
    a = np.zeros((40, 40))
    a[10:30, 10:30] = 255
    a[18:20, 18:20] = 0
    a[2:4, 2:4] = a[35:37, 5:7] = 255
    got = back(op.clean_mask(op.binary(frame(spark, a)), min_size=20), "fg", bool)
    assert brute_labels(got).max() == 1 and got[18:20, 18:20].any()


def test_thresholds(spark):
    a = np.full((40, 40), 60.0)
    a[12:30, 12:30] = 190
    a = np.clip(a + np.random.default_rng(0).normal(0, 10, a.shape), 0, 255).astype(int).astype(float)
    df = frame(spark, a).withColumn("v", F.col("v").cast("int"))
    t = op.otsu(df).first().t
    assert 85 <= t <= 165
    assert abs(back(op.otsu_threshold(df), "fg", bool).sum() - 324) < 30
    assert op.otsu(frame(spark, np.full((4, 4), 7.0))).first().t == 0
    two = np.array([[60.0, 190.0]])
    assert op.otsu(frame(spark, two)).first().t == 60


def test_stretch_histogram_and_missing_pixels(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, float("nan")), ("a", 0, 2, 3.0), ("a", 0, 3, -9.0), ("a", 1, 0, None)], "image_id string, y int, x int, v double")
    v = df.withColumn("v", pt.valid("v", -9))
    assert op.summary(v).first() == (1.0, 3.0, 2.0)
    got = [r.v for r in op.linear_stretch(v).orderBy("y", "x").collect()]
    assert got[0] == 0 and got[1] is None and abs(got[2] - 1) < 1e-6 and got[4] is None
    assert [r.n for r in op.histogram(v, 2).orderBy("bin").collect()] == [1, 1]
    flat = frame(spark, np.full((3, 3), 5.0))
    assert back(op.percentile_stretch(flat)).max() == 0
    assert sum(r.n for r in op.histogram(flat, 10).collect()) == 9
    eq = back(op.equalised(frame(spark, np.arange(64.0).reshape(8, 8))))
    assert eq[7, 7] == 1 and (np.diff(eq.ravel()) >= 0).all()
    c = back(op.clahe(frame(spark, np.random.default_rng(1).random((32, 32)))))
    gone = frame(spark, np.random.default_rng(1).random((32, 32))).withColumn("v", F.when(F.expr("y < 5 or x = 9"), None).otherwise(F.col("v")))
    assert op.clahe(gone).where("v is null").count() == gone.where("v is null").count() == 5 * 32 + 27
    assert 0 <= c.min() and c.max() <= 1
    assert stats.masked_summary(pt.ndvi("v", "v", zero="null"), flat).first()["max"] == 0


def test_indices(spark):
    df = spark.createDataFrame([(0, 0), (10, 30), (200, 100), (None, 3)], "red int, nir int")
    got = [(r.a, r.b) for r in df.select(pt.ndvi("nir", "red").alias("a"), pt.ndvi("nir", "red", zero="null").alias("b")).collect()]
    assert got == [(0.0, None), (0.5, 0.5), (-1 / 3, -1 / 3), (None, None)]
    with pytest.raises(ValueError):
        pt.ndvi("nir", "red", zero="one")
    c = df.limit(1).select(pt.ramp(F.lit(0.25)).alias("c"), pt.luma(F.lit(10), F.lit(20), F.lit(30)).alias("l"), pt.to_byte(F.lit(254.9)).alias("b")).first()
    assert tuple(c.c) == (175, 150, 80) and c.l == 18 and c.b == 254


def brute_glcm(q, dy, dx, levels):
    m = np.zeros((levels, levels))
    h, w = q.shape
    for y in range(h):
        for x in range(w):
            if 0 <= y + dy < h and 0 <= x + dx < w:
                m[q[y, x], q[y + dy, x + dx]] += 1
                m[q[y + dy, x + dx], q[y, x]] += 1
    return m / m.sum()


def brute_features(p):
    i, j = np.indices(p.shape)
    mi, mj = (p * i).sum(), (p * j).sum()
    si, sj = np.sqrt((p * (i - mi) ** 2).sum()), np.sqrt((p * (j - mj) ** 2).sum())
    z = p[p > 0]
    return {"contrast": (p * (i - j) ** 2).sum(), "dissimilarity": (p * abs(i - j)).sum(), "homogeneity": (p / (1 + (i - j) ** 2)).sum(), "energy": np.sqrt((p**2).sum()), "entropy": -(z * np.log2(z)).sum(), "correlation": (p * (i - mi) * (j - mj)).sum() / (si * sj) if si * sj > 1e-9 else 1.0}


def test_texture(spark, noise, strip):
    q = np.clip(noise.astype(int) * 8 // 256, 0, 7)
    for angle, (dy, dx) in {0: (0, 2), 45: (-2, 2), 90: (-2, 0), 135: (-2, -2)}.items():
        got = op.glcm_features(frame(spark, noise), 2, angle).first().asDict()
        want = brute_features(brute_glcm(q, dy, dx, 8))
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    p = np.pad(q, 2, mode="reflect")
    for feature in op.FEATURES:
        got = back(op.texture_map(frame(spark, noise), feature, 5, angle=45))
        want = [[brute_features(brute_glcm(p[y : y + 5, x : x + 5], -1, 1, 8))[feature] for x in range(13)] for y in range(17)]
        assert np.allclose(got, want), feature
    assert op.glcm_features(frame(spark, np.full((4, 4), 9.0))).first().correlation == 1.0


def test_keypoints(spark, strip):
    a = np.full((44, 44), 30.0)
    for y in (8, 26):
        for x in (8, 26):
            a[y : y + 10, x : x + 10] = 220
    df = frame(spark, a)
    h = {(r.y, r.x) for r in op.harris_corners(df).collect()}
    assert len(h) >= 12 and all(min(abs(y - c) for c in (8, 17, 26, 35)) <= 2 for y, _ in h)
    f = {(r.y, r.x) for r in op.fast_corners(df).collect()}
    assert len(f) >= 4 and all(3 <= y < 41 and 3 <= x < 41 for y, x in f)
    o = op.orb_keypoints(df, n_bits=64, max_keypoints=3).collect()
    assert len(o) == 3 and all(len(r.bits) == 64 and set(r.bits) <= {0, 1} for r in o)
    p = brief_pattern(64)
    for r in o:
        c, s = np.cos(r.theta), np.sin(r.theta)
        at = lambda u, v: a[int(np.clip(np.round(r.y + u * c - v * s), 0, 43)), int(np.clip(np.round(r.x + u * s + v * c), 0, 43))]  # noqa: E731, B023
        assert r.bits == [int(at(*q[:2]) < at(*q[2:])) for q in p]
    assert op.fast_corners(frame(spark, a[:6, :6])).count() == 0 and op.harris_corners(frame(spark, np.full((9, 9), 4.0))).count() == 0
    assert op.drawn(df, op.fast_corners(df)).where("r = 255 and g = 0").count() > 0
    one = spark.createDataFrame([("a", 20, 20, float(np.pi / 4))], "image_id string, y int, x int, theta double")
    red = {(r.y, r.x) for r in op.drawn(df, one).where("r = 255 and g = 0").collect()}
    assert {(20 + i, 20 + i) for i in range(5)} <= red and (26, 26) not in red


def test_kmeans(spark):
    a = np.zeros((12, 30))
    a[:, 10:20], a[:, 20:] = 100, 200
    a += np.random.default_rng(0).normal(0, 5, a.shape)
    got, centres = op.kmeans(frame(spark, a), ["v"], 3, seed=1)
    assert sorted(round(c[0], -2) for c in centres) == [0, 100, 200]
    assert got.select("label").distinct().count() == 3 and got.groupBy("label").agg(F.countDistinct("m0").alias("n")).where("n > 1").isEmpty()
    _, centres = op.kmeans(frame(spark, a), ["v"], 4, centroids=[[0], [100], [200], [10**6]])
    assert centres[3] == [10.0**6]  # an empty cluster keeps its centroid


def test_distance():
    m = np.random.default_rng(5).random((20, 30)) < 0.9
    d = chamfer(m)
    by, bx = np.nonzero(~m)
    for y, x in zip(*np.nonzero(m), strict=True):
        dy, dx = abs(by - y), abs(bx - x)
        assert abs(d[y, x] - (np.maximum(dy, dx) + (np.sqrt(2) - 1) * np.minimum(dy, dx)).min()) < 1e-9
    assert chamfer(np.ones((3, 3), bool)).min() == 1e9


def test_watershed(spark):
    y, x = np.mgrid[0:60, 0:90]
    a = np.where(((y - 30) ** 2 + (x - 28) ** 2 <= 17**2) | ((y - 30) ** 2 + (x - 60) ** 2 <= 17**2), 210.0, 40.0)
    lab = back(op.watershed(frame(spark, a)), "label", int)
    assert len({v for v in lab.ravel() if v >= 2}) == 2 and (lab == -1).any()
    assert lab[30, 28] != lab[30, 60] and lab[0, 0] == 1
    colours = op.colourised(spark.createDataFrame([("a", 0, i, v) for i, v in enumerate([1, -1, 0, 2])], "image_id string, y int, x int, label int")).orderBy("x").collect()
    assert [tuple(c)[3:] for c in colours[:3]] == [(50, 50, 50), (255, 0, 0), (0, 0, 0)] and min(tuple(colours[3])[3:]) >= 40
    assert (flood(np.zeros((1, 5)), np.array([[2, 0, 0, 0, 3]])) == [[2, 2, -1, 3, 3]]).all()


def test_missing_and_repeated_pixels(spark, noise):
    """A missing or repeated row is told, not taken for its neighbour; a NULL is a pixel that is not there."""
    df = frame(spark, noise)
    for broken in (df.where("not (y = 5 and x = 6)"), df.union(df.where("y = 5 and x = 6"))):
        with pytest.raises(Exception, match="missing or repeated"):
            op.mean_blur(broken, 3).collect()
    holes = df.withColumn("v", F.when(F.expr("(y + x) % 2 = 0"), F.col("v")))
    got = back(op.median_filter(holes, 3))
    p = np.pad(np.where(np.add.outer(range(17), range(13)) % 2 == 0, noise, np.nan), 1, mode="reflect")
    there = [[sorted(v for v in p[y : y + 3, x : x + 3].ravel() if v == v) for x in range(13)] for y in range(17)]
    assert all(got[y, x] == there[y][x][(len(there[y][x]) - 1) // 2] for y in range(17) for x in range(13))


def test_missing_pixels_stay_missing(spark):
    a = np.random.default_rng(2).integers(0, 256, (12, 14)).astype(float)
    gone = frame(spark, a).withColumn("v", F.when(F.expr("y = 4 and x in (3, 9)"), None).otherwise(F.col("v")))
    assert gone.select(pt.quantise("v", 8).alias("q")).where("q is null").count() == 2
    assert [(r.y, r.x) for r in op.equalised(gone).where("v is null").orderBy("x").collect()] == [(4, 3), (4, 9)]
    assert op.glcm(gone, normed=False, symmetric=False).agg(F.sum("p").alias("n")).first().n == 12 * 13 - 4
    got = {(r.y, r.x): r.v for r in op.texture_map(gone, window=3).collect()}
    part, q = {}, np.floor(a / 32)
    q[4, 3] = q[4, 9] = np.nan
    for y in range(1, 11):
        for x in range(1, 13):
            w = q[y - 1 : y + 2, x - 1 : x + 2]
            part[y, x] = np.nanmean((w[:, 1:] - w[:, :-1]) ** 2)
    assert all(abs(got[k] - v) < 1e-9 for k, v in part.items())
    none = frame(spark, a).withColumn("v", F.lit(None).cast("double"))
    assert op.texture_map(none, window=3).where("v is null").count() == 12 * 14 == op.equalised(none).where("v is null").count()
    assert op.sobel(gone, threshold=10).where("byte is null").count() == op.sobel(gone).where("v is null").count()
