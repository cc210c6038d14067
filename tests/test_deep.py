"""Decoding of deep PNG and TIFF files against the arrays that they were written from."""

import random

import numpy as np
import pytest

from framewright.functions.decode import decode_raster, to_uint8, unfilter, unpack_bits, unpack_lzw
from framewright.plans.quality import quality_run
from framewright.queries.deep import deep_file, lzw, pack_bits, tiff_file
from framewright.queries.png import deep_png
from framewright.sources import files
from framewright.sources.tags import Ranges

RNG = np.random.default_rng(4)


class Stream:
    def __init__(self, body):
        self.body = body

    def size(self):
        return len(self.body)

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.body[self.at : self.at + n]


def decoded(body):
    return decode_raster(Ranges(Stream(body), body[:64]))


def pixels(height, width, channels):
    smooth = np.add.outer(np.arange(height) * 700, np.arange(width) * 300)[:, :, None] + np.arange(channels) * 5000
    return ((smooth + RNG.integers(0, 3000, (height, width, channels))) % 65536).astype(np.uint16)


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 4, 2, 3, 1), (2, 1)])
@pytest.mark.parametrize("shape", [(1, 1, 1), (9, 1, 3), (1, 9, 2), (13, 11, 3), (8, 17, 4), (5, 6, 1)])
def test_png(shape, filters, interlaced):
    image = pixels(*shape)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[shape[2]]
    want = (image >> 8).astype(np.uint8)
    want = want[:, :, 2::-1] if shape[2] >= 3 else want[:, :, :1]
    got = decoded(deep_png(image, colour, filters, interlaced))
    assert got.shape == want.shape and (got == want).all()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("options", [{}, {"differences": True}, {"tile": 16}, {"planar": True}, {"tile": 16, "planar": True, "differences": True}, {"rows": 1000}])
def test_tiff(order, compression, options):
    for shape in ((37, 41, 3), (5, 3, 1)):
        image = pixels(*shape)
        got = decoded(tiff_file(image, order, compression, **options))
        assert (got == (image >> 8).astype(np.uint8)[:, :, ::-1]).all() and got.shape == shape


def test_tiff_of_floats_and_of_32_bits():
    for image in (RNG.normal(0, 50, (9, 7, 1)).astype(np.float32), RNG.integers(0, 2**32, (9, 7, 3)).astype(np.uint32)):
        low, high = int(image.min()), int(image.max())
        want = np.clip((image.astype(float) - low) / (high - low) * 255, 0, 255).astype(np.uint8)
        assert (decoded(tiff_file(image, ">", 8)) == want[:, :, ::-1]).all()
    assert (to_uint8(np.full((2, 2, 1), 7.5)) == 0).all()


def test_packing_round_trips():
    rng = random.Random(3)
    for n in (0, 1, 2, 300, 20_000):
        for body in (bytes(n), bytes(rng.choices(range(256), k=n)), bytes(rng.choices(b"ab", weights=[9, 1], k=n))):
            assert unpack_bits(pack_bits(body)) == body and unpack_lzw(lzw(body)) == body


def test_unfilter_of_a_large_image_is_quick():
    rows = RNG.integers(0, 256, (1500, 1 + 1500 * 6)).astype(np.uint8)
    rows[:, 0] = np.arange(1500) % 5
    assert unfilter(rows, 6).shape == (1500, 9000)


def test_damage_gives_no_raster():
    for k in range(8):
        body = deep_file(k, pixels(8, 8, 1))[1]
        rng = random.Random(k)
        for _ in range(60):
            broken = bytearray(body)
            broken[rng.randrange(8, len(body))] ^= 1 << rng.randrange(8)
            got = decoded(bytes(broken))
            assert got is None or got.ndim == 3
        assert decoded(body[: len(body) // 2]) is None
    assert decoded(b"neither") is None


def test_quality_run_measures_deep_files(spark, tmp_path):
    grey = pixels(64, 48, 1)
    (tmp_path / "a.png").write_bytes(deep_png(grey, 0, (4, 1)))
    (tmp_path / "b.tif").write_bytes(tiff_file(grey, ">", 5, differences=True))
    (tmp_path / "c.tif").write_bytes(tiff_file(grey)[:3000])
    got = {r.path.rsplit("/", 1)[1]: r for r in quality_run(spark, str(tmp_path)).collect()}
    assert not got["a.png"].is_error and not got["b.tif"].is_error
    assert got["a.png"].load_note == files.NOTE_DEPTH and got["a.png"].brightness == got["b.tif"].brightness > 0
    assert abs(got["a.png"].brightness - float((grey >> 8).mean())) < 1e-9
    assert (got["a.png"].width, got["a.png"].height) == (48, 64)
