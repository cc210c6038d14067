"""Metadata of the containers of photos, raw photos and movies: parts as one small file each, read back by ranges."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from framewright.functions import names
from framewright.operators import reconcile as rc
from framewright.queries.base import query, spread_files, table
from framewright.sources import files, tags
from framewright.sources.containers import CANON_BOX, PNG_HEAD, RAF_HEAD
from framewright.sources.shared import shared_folder

ENDINGS = ("cr3", "raf", "orf", "rw2", "tif", "png", "mov", "mp4")


def tiff_bytes(main, shot=(), gps=(), order="<", magic=42) -> bytes:
    """A TIFF structure of folders of (tag, kind, value): kind 2 a text, 3 and 4 a number, 5 pairs of numbers."""
    big = magic == 43
    word, link, inline = ("Q", 20, 8) if big else ("I", 12, 4)
    head = 16 if big else 8

    def packed(kind, value):
        if kind == 2:
            body = value.encode() + b"\0"
            return len(body), body
        if kind == 5:
            return len(value), b"".join(struct.pack(order + "II", *v) for v in value)
        return 1, struct.pack(order + ("H" if kind == 3 else "I"), value)

    def folder(entries, at):
        """The folder that stands at `at`, with its values right behind it."""
        size = (8 if big else 2) + link * len(entries) + struct.calcsize(order + word)
        cells, values = b"", b""
        for tag, kind, value in sorted(entries):
            n, body = packed(kind, value)
            cells += struct.pack(order + "HH" + word, tag, kind, n)
            if len(body) <= inline:
                cells += body.ljust(inline, b"\0")
            else:
                cells += struct.pack(order + word, at + size + len(values))
                values += body + b"\0" * (len(body) % 2)
        return struct.pack(order + ("Q" if big else "H"), len(entries)) + cells + struct.pack(order + word, 0) + values

    start = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", magic)
    start += struct.pack(order + "HHQ", 8, 0, head) if big else struct.pack(order + "I", head)
    links = [(0x8769, 4, 0)] * bool(shot) + [(0x8825, 4, 0)] * bool(gps)
    at = head + len(folder([*main, *links], head))
    parts, placed = b"", []
    for tag, entries in ((0x8769, shot), (0x8825, gps)):
        if entries:
            placed.append((tag, 4, at + len(parts)))
            parts += folder(entries, at + len(parts))
    return start + folder([*main, *placed], head) + parts


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def jpeg_bytes(tiff: bytes) -> bytes:
    segment = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\x10JFIF\0" + bytes(9) + b"\xff\xe1" + struct.pack(">H", 2 + len(segment)) + segment + b"\xff\xd9"


def movie_bytes(make: str, model: str, seconds: int, keyed: bool) -> bytes:
    """A movie whose header follows its pictures; camera names by key (mov) or as user data (mp4)."""
    date = struct.pack(">II", 0, seconds) + bytes(16)
    if keyed:
        keys = [b"com.apple.quicktime.make", b"com.apple.quicktime.model"]
        listed = b"".join(struct.pack(">I", 8 + len(k)) + b"mdta" + k for k in keys)
        items = [box(struct.pack(">I", i + 1), box(b"data", b"\0\0\0\1" + bytes(4), v.encode())) for i, v in enumerate((make, model))]
        names_ = box(b"meta", box(b"hdlr", bytes(8), b"mdta", bytes(12)), box(b"keys", bytes(4), struct.pack(">I", 2), listed), box(b"ilst", *items))
    else:
        text = lambda v: struct.pack(">HH", len(v.encode()), 0) + v.encode()
        names_ = box(b"udta", box(b"\xa9mak", text(make)), box(b"\xa9mod", text(model)))
    track = box(b"trak", box(b"mdia", box(b"mdhd", date)))
    wide = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + 500) + bytes(500)  # a box with a 64-bit size
    return box(b"ftyp", b"qt  " if keyed else b"mp42") + wide + box(b"moov", box(b"mvhd", date), track, names_)


def container_bytes(kind: str, make: str, model: str, lens: str, size: int, k: int) -> bytes:
    """One file of the named kind with all its metadata."""
    if kind in ("mov", "mp4"):
        return movie_bytes(make, model, 3_786_912_000 + 86_400 * (k % 365), kind == "mov")
    main = [(0x010F, 2, make), (0x0110, 2, model), (0x0112, 3, 1 + k % 8)]
    shot = [
        (0x829A, 5, [(1, size * 10)]), (0x829D, 5, [(size + 10, 10)]), (0x8827, 3, 100 + k % 50 * 100), (0x920A, 5, [(size, 1)]),
        (0x9003, 2, f"2024:05:{1 + k % 28:02d} 07:08:09"), (0xA434, 2, lens),
    ]
    gps = [(1, 2, "N"), (2, 5, [(k % 90, 1), (k % 60, 1), (k % 600, 10)]), (3, 2, "W"), (4, 5, [(k % 180, 1), (k % 59, 1), (k % 599, 10)])]
    if kind == "cr3":
        blocks = [(b"CMT1", tiff_bytes(main)), (b"CMT2", tiff_bytes(shot)), (b"CMT3", tiff_bytes([])), (b"CMT4", tiff_bytes(gps))]
        own = box(b"uuid", CANON_BOX, box(b"CNCV", b"CanonCR3"), *[box(name, body) for name, body in blocks])
        return box(b"ftyp", b"crx ") + box(b"moov", own, box(b"mvhd", bytes(24))) + box(b"mdat", bytes(2000))
    if kind == "raf":
        preview = jpeg_bytes(tiff_bytes(main, shot, gps))
        head = RAF_HEAD + b"0201" + bytes(8) + model.encode().ljust(32, b"\0")[:32]
        return head.ljust(84, b"\0") + struct.pack(">II", 3000, len(preview)) + bytes(3000 - 92) + preview + bytes(100)
    if kind == "orf":
        return tiff_bytes(main, shot, gps, "<", 0x4F52)
    if kind == "rw2":  # the shot only in the preview, but for ISO
        preview = jpeg_bytes(tiff_bytes(main, [e for e in shot if e[0] != 0x8827], gps))
        body = tiff_bytes([*main, (0x0017, 3, 100 + k % 50 * 100), (0x002E, 4, 600)], magic=0x55)
        return body.ljust(600, b"\0") + preview
    if kind == "tif":
        return tiff_bytes(main, shot, gps, ">", 43)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + bytes(4)
    header = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 16, 0, 0, 0, 0))
    return PNG_HEAD + header + chunk(b"IDAT", bytes(700)) + chunk(b"eXIf", tiff_bytes(main, shot, gps)) + chunk(b"IEND", b"")


def landed_containers(spark, sf):
    """Paths of the written files, a thousand keys to a folder."""

    def build(batches):
        for batch in batches:
            rows = []
            for k, make, model, lens, size in zip(*(batch[c].tolist() for c in ("p_partkey", "p_brand", "p_type", "p_name", "p_size"))):
                kind = ENDINGS[k % len(ENDINGS)]
                rows.append((f"{k // 1000:05d}/{k:08d}.{kind}", container_bytes(kind, make, model, lens, size, k)))
            yield pd.DataFrame(rows, columns=["name", "content"])

    root = shared_folder(spark, "containers")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name", F.col("p_size").cast("long").alias("p_size"))
    made = spread_files(parts, "p_partkey").mapInPandas(build, "name string, content binary")
    files.land_files(made, root).write.format("noop").mode("overwrite").save()
    return files.list_files(spark, root).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


KINDS_SQL = """
kinds AS (SELECT p_partkey AS k, p_brand, p_type, p_name, p_size, ['cr3','raf','orf','rw2','tif','png','mov','mp4'][p_partkey % 8 + 1] AS kind FROM part),
named AS (SELECT *, printf('%08d.', k) || kind AS name, kind IN ('mov', 'mp4') AS movie,
  strftime(make_timestamp(1704067200000000 + 86400000000 * (k % 365)), '%Y:%m:%d %H:%M:%S') AS made FROM kinds)
"""


@query(
    "s4_containers",
    f"""WITH {KINDS_SQL}, photos AS (SELECT * FROM named WHERE NOT movie), movies AS (SELECT * FROM named WHERE movie)
    SELECT name, 'make' AS tag, p_brand AS value FROM named UNION ALL SELECT name, 'model', p_type FROM named
    UNION ALL SELECT name, 'orientation', CAST(1 + k % 8 AS VARCHAR) FROM photos
    UNION ALL SELECT name, 'aperture', CAST(CAST((p_size + 10) / 10 AS DOUBLE) AS VARCHAR) FROM photos
    UNION ALL SELECT name, 'shutter', CAST(CAST(1 AS DOUBLE) / (p_size * 10) AS VARCHAR) FROM photos
    UNION ALL SELECT name, 'iso', CAST(100 + k % 50 * 100 AS VARCHAR) FROM photos
    UNION ALL SELECT name, 'focal_length', CAST(CAST(p_size AS DOUBLE) AS VARCHAR) FROM photos
    UNION ALL SELECT name, 'datetime', printf('2024:05:%02d 07:08:09', 1 + k % 28) FROM photos
    UNION ALL SELECT name, 'lens_model', p_name FROM photos
    UNION ALL SELECT name, 'lat_ref', 'N' FROM photos UNION ALL SELECT name, 'lon_ref', 'W' FROM photos
    UNION ALL SELECT name, 'lat', concat_ws(' ', CAST(k % 90 AS DOUBLE), CAST(k % 60 AS DOUBLE), CAST((k % 600) / 10 AS DOUBLE)) FROM photos
    UNION ALL SELECT name, 'lon', concat_ws(' ', CAST(k % 180 AS DOUBLE), CAST(k % 59 AS DOUBLE), CAST((k % 599) / 10 AS DOUBLE)) FROM photos
    UNION ALL SELECT name, 'create_date', made FROM movies UNION ALL SELECT name, 'media_create_date', made FROM movies""",
)
def s4_containers(spark, sf):
    """Tags of raw photos, BigTIFF, PNG and movies, from ranges of the files."""
    found = files.probe_files(landed_containers(spark, sf), ())
    return tags.tag_rows(found).select(names.base_name("path").alias("name"), "tag", "value")


@query(
    "r9_container_dates",
    f"""WITH {KINDS_SQL} SELECT name, CASE WHEN movie THEN replace(left(made, 10), ':', '-') ELSE printf('2024-05-%02d', 1 + k % 28) END AS date_str,
      'exif' AS date_source, trim(p_type) AS model, CASE WHEN movie THEN '' ELSE trim(p_name) END AS lens,
      CASE WHEN movie THEN '' ELSE p_size || 'mm' END AS focal, CASE WHEN movie THEN 'video' ELSE 'photo' END AS media FROM named""",
)
def r9_container_dates(spark, sf):
    """What the backup plan says of the same files: the day of each comes from its own metadata, none from the file system."""
    listing = landed_containers(spark, sf)
    records = tags.metadata_records(files.probe_files(listing, ()))
    return rc.file_metadata(listing, records).select(names.base_name("path").alias("name"), "date_str", "date_source", "model", "lens", "focal", "media")
