"""Keypoints under known turns and zooms, and the second detector where the first one fails."""

import numpy as np
import pytest

from framewright.functions import features, geometry
from framewright.operators import overlap


def scene(height=360, width=420, seed=3):
    """Blobs and bars of many sizes, smooth enough to be resampled."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width].astype(np.float32)
    out = np.full((height, width), 110.0, np.float32)
    for _ in range(260):
        cy, cx, s, a = rng.uniform(0, height), rng.uniform(0, width), rng.uniform(2, 12), rng.uniform(-90, 90)
        stretch, turn = rng.uniform(1, 2.5), rng.uniform(0, np.pi)
        u, v = (x - cx) * np.cos(turn) + (y - cy) * np.sin(turn), (y - cy) * np.cos(turn) - (x - cx) * np.sin(turn)
        out += a * np.exp(-0.5 * ((u / s / stretch) ** 2 + (v / s) ** 2))
    return np.clip(out, 0, 255)


def warped(image, angle, zoom):
    """The image turned about its middle and zoomed, by bilinear samples, and the homography that does it."""
    h, w = image.shape
    c, s, mid = np.cos(angle) * zoom, np.sin(angle) * zoom, np.array([(w - 1) / 2, (h - 1) / 2])
    m = np.array([[c, -s], [s, c]])
    y, x = np.mgrid[0:h, 0:w]
    at = (np.stack([x.ravel(), y.ravel()], 1) - mid) @ np.linalg.inv(m).T + mid
    u, v = np.clip(at[:, 0], 0, w - 1.001), np.clip(at[:, 1], 0, h - 1.001)
    i, j = v.astype(int), u.astype(int)
    p, q = v - i, u - j
    out = image[i, j] * (1 - p) * (1 - q) + image[i + 1, j] * p * (1 - q) + image[i, j + 1] * (1 - p) * q + image[i + 1, j + 1] * p * q
    homography = np.eye(3)
    homography[:2, :2], homography[:2, 2] = m, mid - m @ mid
    inside = (at >= 0).all(1) & (at[:, 0] <= w - 1) & (at[:, 1] <= h - 1)
    return np.where(inside, out, 110).reshape(h, w).astype(np.uint8), homography


def matched(a, b, bits=False):
    if bits:
        (pa, da), (pb, db) = (features.detect_binary(x, 2000) for x in (a, b))
        near, dist = features.two_nearest_bits(da, db)
    else:
        (pa, *_, da), (pb, *_, db) = (features.detect_keypoints(x, 2000) for x in (a, b))
        near, dist = geometry.two_nearest(da, db)
    good = dist[:, 0] < 0.8 * dist[:, 1]
    return geometry.ransac_homography(pa[good], pb[near[good, 0]], 3.0, seed=1)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("angle, zoom", [(0, 1.0), (30, 1.0), (90, 1.0), (135, 1.0), (0, 1.5), (30, 1.5), (-70, 0.7)])
def test_turned_and_zoomed_frames_match(angle, zoom, bits):
    image = scene()
    other, truth = warped(image, np.radians(angle), zoom)
    h, inside = matched(image.astype(np.uint8), other, bits)
    assert h is not None and inside.sum() >= 25, inside.sum()
    corners = np.array([[120, 100], [300, 100], [300, 260], [120, 260]], float)
    assert np.abs(geometry.project(h, corners) - geometry.project(truth, corners)).max() < 3


def test_scales_and_angles_follow_the_image():
    y, x = np.mgrid[0:200, 0:200]
    for s in (4.0, 8.0, 14.0):
        blob = np.rint(60 + 150 * np.exp(-0.5 * (((x - 100) / s) ** 2 + ((y - 90) / s) ** 2))).astype(np.uint8)
        xy, strength, scale, _, _ = features.detect_keypoints(blob, 100)
        assert np.abs(xy[0] - [100, 90]).max() < 0.5 and abs(scale[0] / s - 1) < 0.25 and strength[0] > 10


def test_large_images_are_halved_and_places_are_in_whole_pixels():
    y, x = np.mgrid[0:1200, 0:1400]
    blob = lambda s: np.rint(60 + 150 * np.exp(-0.5 * (((x - 801) / s) ** 2 + ((y - 333) / s) ** 2))).astype(np.uint8)
    xy, *_ = features.detect_keypoints(blob(20), 10)
    assert np.abs(xy[0] - [801, 333]).max() < 0.6
    xy, _ = features.detect_binary(blob(8), 10)
    assert len(xy) and np.abs(xy[0] - [801, 333]).max() < 6


@pytest.mark.parametrize("shape", [(1, 1), (3, 200), (15, 15), (40, 40)])
def test_flat_and_tiny_images_have_none(shape):
    flat = np.full(shape, 128, np.uint8)
    xy, strength, scale, angle, d = features.detect_keypoints(flat, 100)
    assert len(xy) == len(strength) == len(scale) == len(angle) == len(d) == 0 and d.shape[1] == 128
    xy, bits = features.detect_binary(flat, 100)
    assert len(xy) == 0 and bits.shape[1] % 8 == 0


def test_the_limit_keeps_the_strongest():
    image = scene().astype(np.uint8)
    _, every, *_ = features.detect_keypoints(image, 10_000)
    _, some, *_ = features.detect_keypoints(image, 50)
    assert len(some) == 50 and some.min() >= np.sort(every)[-50] - 1e-3 and (np.diff(some) <= 0).all()


def test_two_nearest_bits_against_counts():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 256, (40, 16)).astype(np.uint8), rng.integers(0, 256, (50, 16)).astype(np.uint8)
    near, dist = features.two_nearest_bits(a, b, rows=7)
    d = np.array([[bin(int.from_bytes(bytes(x ^ y), "big")).count("1") for y in b] for x in a])
    assert (dist == np.sort(d, 1)[:, :2]).all() and (d[np.arange(40), near[:, 0]] == dist[:, 0]).all()
    near, dist = features.two_nearest_bits(a, b[:1])
    assert (near[:, 1] == -1).all() and np.isinf(dist[:, 1]).all()


def test_pair_overlap_of_turned_frames(spark):
    """A turned and zoomed frame overlaps; so does a dim one, in which only the second detector finds enough."""
    image = scene()
    turned, _ = warped(image, np.radians(30), 1.2)
    dim = (118 + (image - 110) / 14).astype(np.uint8)
    frames = {"a": image.astype(np.uint8), "b": turned, "c": dim, "d": np.roll(dim, 5, axis=1), "e": np.full((64, 64), 9, np.uint8)}
    rows = [(k, *v.shape, 1, bytearray(v.tobytes())) for k, v in frames.items()]
    rasters = spark.createDataFrame(rows, "path string, height int, width int, n_channels int, data binary")
    pairs = spark.createDataFrame([("a", "b"), ("c", "d"), ("d", "e")], "path string, next_path string")
    got = {r.path: r for r in overlap.pair_overlap(pairs, rasters).collect()}
    assert got["a"].overlap_next > 0.6 and got["a"].overlap_inlier_ratio > 0.5
    first = overlap.detect_keypoints(rasters.filter("path in ('c', 'd')")).collect()
    assert max(len(r.kp_x) for r in first) < 20, "too few for the first detector"
    assert got["c"].overlap_next > 0.9 and got["c"].overlap_matches >= 20
    assert (got["d"].overlap_next, got["d"].overlap_matches) == (0.0, 0)
