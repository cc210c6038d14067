import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.config import DEFAULTS, QualityParams
from framewright.functions import features, geometry, pixels
from framewright.operators import measures
from framewright.schemas import EXIF

import rasters

WANTED = ("blocks", *measures.MEASURES)
RASTER = "name string, height int, width int, n_channels int, data binary"


def frame(spark, images):
    rows = [(k, *rasters.bgr(v).shape, rasters.bgr(v).tobytes()) for k, v in images.items()]
    return spark.createDataFrame(rows, RASTER)


@pytest.fixture(scope="module")
def measured(spark):
    images = rasters.named()
    df = frame(spark, images).union(spark.createDataFrame([("broken", -1, -1, -1, None)], RASTER))
    df = measures.image_measures(df, ["name"], wanted=WANTED).withColumn("exif", F.lit(None).cast(EXIF))
    return {r.name: r for r in measures.score_rows(df).collect()}


def test_flat_has_no_signal(measured):
    r = measured["flat"]
    assert r.laplacian_variance == r.sobel_variance == r.contrast == r.edge_density == 0
    assert r.mb_lag_aniso == 1 and r.feature_uniformity == 1 and r.composite_score == 0 and r.is_blurry
    assert r.brightness == r.luma_median == 128 and r.dynamic_range == 0


def test_sharp_rasters(measured):
    assert measured["checker"].composite_score > 0.8
    assert not measured["texture"].is_blurry and measured["texture"].feature_density > 2
    assert measured["subject"].sharpness_spread < 0.6 and not measured["subject"].is_blurry


def test_directional_cues(measured):
    assert measured["smear"].mb_lag_aniso < measured["texture"].mb_lag_aniso
    assert measured["smear"].mb_delta_conc > measured["texture"].mb_delta_conc
    assert measured["ramp"].sobel_aniso < 0.01


def test_exposure_cues(measured):
    r = measured["clipped"]
    assert r.clip_high == pytest.approx(5 / 96) and r.clip_low == pytest.approx(29 / 96) and not r.clipping_ok
    assert measured["vignette"].vignetting < 0.5 and measured["vignette"].has_vignetting


def test_tiny_and_broken(measured):
    assert measured["tiny"].feature_density == 0 and measured["tiny"].feature_uniformity == 1
    assert measured["broken"].is_error and measured["broken"].brightness is None


def naive_sobel_pair(g, y, x):
    h, w = g.shape
    at = lambda i, j: int(g[abs(i) if i < h else 2 * h - 2 - i, abs(j) if j < w else 2 * w - 2 - j])
    gx = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    lap = at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x)
    blur = sum(a * b * at(y + i, x + j) for i, a in ((-1, 1), (0, 2), (1, 1)) for j, b in ((-1, 1), (0, 2), (1, 1)))
    return gx, gy, lap, abs(int(g[y, x]) - (blur + 8) // 16)


def test_kernels_against_loops():
    rng = np.random.default_rng(5)
    g = rng.integers(0, 256, (16, 16), dtype=np.uint8)
    gx, gy = pixels.sobel(g)
    lap, res = pixels.laplacian(g), pixels.blur_residual(g)
    for y in range(16):
        for x in range(16):
            assert (gx[y, x], gy[y, x], lap[y, x], res[y, x]) == naive_sobel_pair(g, y, x)


def test_corner_response_against_loops():
    g = np.random.default_rng(6).integers(0, 256, (16, 12), dtype=np.uint8)
    gx, gy = (a / (4 * 5 * 255) for a in pixels.sobel(g))
    h, w = g.shape
    fold = lambda i, n: abs(i) if i < n else 2 * n - 2 - i
    got = pixels.corner_response(g)
    for y in range(h):
        for x in range(w):
            near = [(fold(y + i, h), fold(x + j, w)) for i in range(-2, 3) for j in range(-2, 3)]
            a, b, c = (sum(u[p] * v[p] for p in near) for u, v in ((gx, gx), (gx, gy), (gy, gy)))
            assert got[y, x] == pytest.approx(a * c - b * b - 0.04 * (a + c) ** 2, abs=1e-12)


def test_canny_against_loops():
    g = rasters.texture(48, 48, seed=2)
    low, high = 40, 160
    gx, gy = pixels.sobel(g, border="edge")
    m = np.pad(np.abs(gx) + np.abs(gy), 1)
    keep = np.zeros((50, 50), bool)
    for y in range(1, 49):
        for x in range(1, 49):
            v, a, b = m[y, x], abs(int(gx[y - 1, x - 1])), abs(int(gy[y - 1, x - 1]))
            if v <= low:
                continue
            if b < a * math.tan(math.pi / 8):
                keep[y, x] = v > m[y, x - 1] and v >= m[y, x + 1]
            elif b > a * math.tan(3 * math.pi / 8):
                keep[y, x] = v > m[y - 1, x] and v >= m[y + 1, x]
            else:
                s = -1 if (gx[y - 1, x - 1] < 0) != (gy[y - 1, x - 1] < 0) else 1
                keep[y, x] = v > m[y - 1, x - s] and v > m[y + 1, x + s]
    edge = {p for p in zip(*np.nonzero(keep)) if m[p] > high}
    todo = list(edge)
    while todo:
        y, x = todo.pop()
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                q = (y + i, x + j)
                if keep[q] and q not in edge:
                    edge.add(q)
                    todo.append(q)
    assert pixels.edge_pixels(g, low, high) == len(edge)


def test_downsample_is_the_area_mean():
    a = np.arange(64, dtype=np.uint8).reshape(8, 8)
    half = pixels.area_downsample(a, 4)
    assert (half == np.rint(a.reshape(4, 2, 4, 2).mean(axis=(1, 3)))).all()
    assert pixels.area_downsample(np.full((30, 50), 77, np.uint8), 13).shape == (7, 13)
    assert (pixels.area_downsample(np.full((30, 50), 77, np.uint8), 13) == 77).all()


def test_orientation_is_exif_standard():
    a = np.arange(6).reshape(2, 3)
    assert pixels.orient(a, 6).tolist() == np.rot90(a, -1).tolist()
    assert pixels.orient(a, 8).tolist() == np.rot90(a).tolist()
    assert pixels.orient(a, 3).tolist() == np.rot90(a, 2).tolist()
    assert pixels.orient(a, 2).tolist() == a[:, ::-1].tolist()
    assert pixels.orient(a, 4).tolist() == a[::-1].tolist()
    assert pixels.orient(a, 5).tolist() == a.T.tolist()
    assert pixels.orient(a, 7).tolist() == np.rot90(a.T, 2).tolist()


def test_measures_against_numpy(spark, measured):
    g = rasters.named()["texture"].astype(np.float64)
    r = measured["texture"]
    assert r.brightness == pytest.approx(g.mean()) and r.contrast == pytest.approx(g.std())
    assert r.dynamic_range == pytest.approx(np.percentile(g, 95) - np.percentile(g, 5))
    gx, gy = pixels.sobel(g.astype(np.uint8))
    norm = np.hypot(gx, gy)
    assert r.sobel_variance == pytest.approx(norm.var()) and r.tenengrad == pytest.approx((norm**2).mean())
    assert r.gradient_p95 == pytest.approx(np.percentile(norm, 95))
    lap = pixels.laplacian(g.astype(np.uint8))
    assert r.laplacian_variance == pytest.approx(lap.var())
    assert np.allclose(r.blocks, [lap[i * 12 : i * 12 + 12, j * 16 : j * 16 + 16].var() for i in range(8) for j in range(8)])
    p_low, p_high = pixels.band_energies(g.astype(np.uint8))
    assert r.mb_delta_conc == pytest.approx(p_high.max() / p_high.sum() - p_low.max() / p_low.sum())


def test_switched_off_checks_are_neutral(spark):
    off = QualityParams(clip_check=False, feature_check=False, motion_blur_check=False)
    df = measures.image_measures(frame(spark, {"clipped": rasters.named()["clipped"]}), ["name"], p=off, wanted=WANTED)
    r = measures.score_rows(df.withColumn("exif", F.lit(None).cast(EXIF)), off).first()
    assert (r.clip_high, r.clip_low, r.feature_density, r.feature_uniformity, r.mb_lag_aniso) == (0, 0, 0, 1, 1)
    assert r.clipping_ok and not r.low_features


def test_partitioning_changes_nothing(spark, measured):
    df = measures.image_measures(frame(spark, rasters.named()).repartition(5), ["name"], wanted=WANTED)
    for r in df.collect():
        assert r.blocks == measured[r.name].blocks and r.wb_kelvin == measured[r.name].wb_kelvin


def test_shifted_copy_gives_its_homography():
    big = np.kron(np.random.default_rng(0).integers(0, 256, (40, 80), dtype=np.uint8), np.ones((8, 8), np.uint8))
    a, b = big[:, :480], big[:, 120:600]
    pa, *_, da = features.detect_keypoints(a, 1500)
    pb, *_, db = features.detect_keypoints(b, 1500)
    near, dist = geometry.two_nearest(da, db)
    good = dist[:, 0] < 0.75 * dist[:, 1]
    h, inside = geometry.ransac_homography(pa[good], pb[near[good, 0]], 5.0, seed=1)
    assert inside.sum() > 100 and np.allclose(h, [[1, 0, -120], [0, 1, 0], [0, 0, 1]], atol=0.05)


def test_two_nearest_against_brute_force():
    rng = np.random.default_rng(9)
    q, t = rng.normal(size=(50, 8)), rng.normal(size=(70, 8))
    near, dist = geometry.two_nearest(q, t, rows=16)
    d = np.linalg.norm(q[:, None] - t[None], axis=2)
    assert (near == np.argsort(d, axis=1)[:, :2]).all() and np.allclose(dist, np.sort(d, axis=1)[:, :2])
    near, dist = geometry.two_nearest(q, t[:1])
    assert (near[:, 1] == -1).all() and np.isinf(dist[:, 1]).all()
