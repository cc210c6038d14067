"""Tags are found wherever their folder stands in a file."""

import struct

import pytest

from framewright.plans import backup, quality
from framewright.sources import files
from framewright.sources.tags import header_tags

SIDE = 400  # 16-bit pixels of this square exceed the first read


def late_tiff(order="<"):
    """A 16-bit grey TIFF with its pixels first, then the folder of the shot, values and the main folder."""
    pixels = struct.pack(order + "H", 0x1234) * SIDE * SIDE
    at = 8 + len(pixels)
    made = b"2021:03:04 05:06:07\0"
    fraction = struct.pack(order + "II", 28, 10)
    values = made + fraction
    shot = [(0x829D, 5, 1, at + len(made)), (0x8827, 3, 1, 800), (0x9004, 2, len(made), at)]
    main = [
        (0x0100, 3, 1, SIDE), (0x0101, 3, 1, SIDE), (0x0102, 3, 1, 16), (0x0103, 3, 1, 1), (0x0106, 3, 1, 1),
        (0x0111, 4, 1, 8), (0x0112, 3, 1, 6), (0x0115, 3, 1, 1), (0x0116, 3, 1, SIDE), (0x0117, 4, 1, len(pixels)),
        (0x8769, 4, 1, at + len(values)),
    ]

    def folder(entries):
        cells = [struct.pack(order + "HHI", *e[:3]) + (struct.pack(order + "H", e[3]) + b"\0\0" if e[1] == 3 else struct.pack(order + "I", e[3])) for e in entries]
        return struct.pack(order + "H", len(entries)) + b"".join(cells) + b"\0" * 4

    tail = values + folder(shot)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at + len(tail)) + pixels + tail + folder(main)


@pytest.fixture(scope="module", params=["<", ">"])
def folder(request, tmp_path_factory):
    root = tmp_path_factory.mktemp("late")
    (root / "late.tif").write_bytes(late_tiff(request.param))
    assert (root / "late.tif").stat().st_size > files.HEAD_BYTES
    return str(root)


def test_a_deep_tiff_is_reduced(spark, folder):
    (row,) = files.load_rasters(spark, folder).collect()
    assert not row.is_error and row.load_note == files.NOTE_DEPTH and row.turn_tag == 6
    assert (row.height, row.width, row.n_channels, row.data) == (SIDE, SIDE, 1, bytes([0x12]) * SIDE * SIDE)


def test_facts_and_records(spark, folder):
    (row,) = quality.file_facts(spark, folder).collect()
    assert (row.exif.orientation, row.exif.iso, row.exif.aperture) == (6, 800.0, 2.8) and len(row.md5) == 32
    listing = spark.createDataFrame([(f"{folder}/late.tif",)], "path string")
    (record,) = backup.records(listing).collect()
    assert record.CreateDate == "2021-03-04"


def test_reads_stay_small(folder):
    with files.open_file(f"{folder}/late.tif") as stream:
        whole = stream.read()
        read = []

        class Counted:
            def size(self):
                return stream.size()

            def seek(self, at):
                stream.seek(at)

            def read(self, n):
                read.append(n)
                return stream.read(n)

        found = header_tags(files.Ranges(Counted(), whole[:1000]))
    assert found == header_tags(whole) and found["bits"] == "16" and sum(read) < 1000
