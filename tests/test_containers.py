"""Metadata of containers: what is found, that damage does not fail, and that only ranges are read."""

import random
import struct

import pytest

from framewright.plans import backup
from framewright.queries.containers import ENDINGS, box, container_bytes, jpeg_bytes, movie_bytes, tiff_bytes
from framewright.sources.containers import find_blocks, movie_tags, tiff_header
from framewright.sources.tags import Ranges, header_tags

FACTS = ("Make", "Some model", "A lens", 25, 13)


class Counted:
    """A stream that notes how much is read."""

    def __init__(self, body):
        self.body, self.at, self.total = body, 0, 0

    def size(self):
        return len(self.body)

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.total += n
        self.at += n
        return self.body[self.at - n : self.at]


@pytest.mark.parametrize("kind", ENDINGS)
def test_tags_are_found(kind):
    found = header_tags(container_bytes(kind, *FACTS))
    assert (found["make"], found["model"]) == ("Make", "Some model")
    if kind in ("mov", "mp4"):
        assert found["create_date"] == found["media_create_date"] == "2024:01:14 00:00:00"
    else:
        assert found["datetime"] == "2024:05:14 07:08:09" and found["lens_model"] == "A lens"
        assert (found["orientation"], found["iso"], found["focal_length"], found["lat_ref"]) == ("6", "1400", "25.0", "N")


@pytest.mark.parametrize("kind", ENDINGS)
def test_only_ranges_are_read(kind):
    """Pixels of 5 MB stand before, or behind, what is looked for; none of them is read."""
    body = container_bytes(kind, *FACTS)
    if kind in ("mov", "mp4"):
        head, rest = body[: 8 + len(body[8 : struct.unpack(">I", body[:4])[0]])], body[struct.unpack(">I", body[:4])[0] :]
        body = head + box(b"free", bytes(5_000_000)) + rest
    elif kind == "png":
        body = body[:8] + struct.pack(">I", 5_000_000) + b"junk" + bytes(5_000_004) + body[8:]
    else:
        body += bytes(5_000_000)
    stream = Counted(body)
    assert header_tags(Ranges(stream, body[:100])) == header_tags(container_bytes(kind, *FACTS))
    assert stream.total < 20_000


@pytest.mark.parametrize("kind", ENDINGS)
def test_damage_never_fails(kind):
    body, rng = container_bytes(kind, *FACTS), random.Random(kind)
    for n in range(0, len(body), 37):
        header_tags(body[:n])
    for _ in range(300):
        broken = bytearray(body)
        for _ in range(rng.randint(1, 6)):
            broken[rng.randrange(min(len(body), 900))] = rng.randrange(256)
        header_tags(bytes(broken))


def test_variants_of_headers():
    for magic, order in ((42, "<"), (42, ">"), (0x4F52, "<"), (0x5352, "<"), (0x55, "<")):
        assert tiff_header(_whole(tiff_bytes([(0x010F, 2, "M")], order=order, magic=magic))).magic == magic
    assert tiff_header(_whole(b"II*\0")) is None and tiff_header(_whole(b"XX*\0" + bytes(20))) is None
    assert header_tags(tiff_bytes([(0x010F, 2, "M")], [(0x8827, 3, 7)], order=">", magic=43)) == {"make": "M", "iso": "7"}


def _whole(body):
    return Ranges(Counted(body), body)


def test_fill_bytes_before_the_exif_segment():
    body = jpeg_bytes(tiff_bytes([(0x010F, 2, "Maker")]))
    assert header_tags(body[:2] + b"\xff\xff\xff" + body[2:])["make"] == "Maker"
    assert find_blocks(_whole(b"\xff\xd8\xff\xda" + bytes(50))) == []


def test_movies_without_names_or_dates():
    assert movie_tags(_whole(box(b"ftyp", b"qt  ") + box(b"moov", box(b"mvhd", bytes(24))))) == {}
    assert movie_tags(_whole(b"no boxes at all, only text")) == {}
    endless = movie_bytes("A", "B", 10, True)[:-4]
    assert movie_tags(_whole(endless)).get("make") in (None, "A")
    to_the_end = box(b"ftyp", b"qt  ") + b"\0\0\0\0moov" + box(b"mvhd", struct.pack(">II", 0, 86_400) + bytes(16))
    assert movie_tags(_whole(to_the_end))["create_date"] == "1904:01:02 00:00:00"


def test_raf_names_its_model_without_a_preview(spark, tmp_path):
    body = container_bytes("raf", *FACTS)
    (tmp_path / "a.raf").write_bytes(body[:2000])
    (tmp_path / "b.cr3").write_bytes(container_bytes("cr3", *FACTS))
    (tmp_path / "c.rw2").write_bytes(b"")
    listing = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.raf", "b.cr3", "c.rw2", "gone.orf")], "path string")
    rows = {r.path.rsplit("/", 1)[1]: r for r in backup.records(listing).collect()}
    assert rows["a.raf"].Model == "Some model" and rows["a.raf"].DateTimeOriginal is None
    assert (rows["b.cr3"].DateTimeOriginal, rows["b.cr3"].FocalLength) == ("2024-05-14", "25.0")
    assert rows["c.rw2"].Model is None and rows["gone.orf"].Model is None
