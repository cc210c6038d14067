"""Image metadata: raw tags out of the file header, then typed columns."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.names import strip
from framewright.sources.containers import RW2_MAGIC, Block, Header, find_blocks, jpeg_block, movie_tags, raf_model, tiff_header

# Tag numbers of the Exif standard that are read, and the folders (IFDs) that hold them.
MAIN_TAGS = {0x0102: "bits", 0x010F: "make", 0x0110: "model", 0x0112: "orientation"}
SHOT_TAGS = {0x829D: "aperture", 0x829A: "shutter", 0x8827: "iso", 0x920A: "focal_length", 0x9003: "datetime"}
MORE_TAGS = {0x9004: "create_date", 0xA432: "lens_spec", 0xA434: "lens_model"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
SHOT_FOLDER, GPS_FOLDER = 0x8769, 0x8825
RW2_ISO, PREVIEW = 0x0017, 0x002E  # of RW2 only
MOVIE_DATE = "media_create_date"
KNOWN = {*MAIN_TAGS, *SHOT_TAGS, *MORE_TAGS, *GPS_TAGS, SHOT_FOLDER, GPS_FOLDER, RW2_ISO}
VALUE_BYTES = 1 << 24  # a longer value of a known tag is damaged, and not read
MOST_ENTRIES = 65_535  # of a folder; more are damage
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8, 13: 4, 16: 8, 18: 8}
NUMBERS = {1: "B", 3: "H", 4: "I", 7: "B", 9: "i", 13: "I", 16: "Q", 18: "Q"}
TAG_NAMES = (*MAIN_TAGS.values(), *SHOT_TAGS.values(), *MORE_TAGS.values(), *GPS_TAGS.values(), MOVIE_DATE)


class Ranges:
    """Reads of any place in an open file; what its first bytes hold is not read again."""

    def __init__(self, stream, first: bytes):
        self.stream, self.first, self.size = stream, first, stream.size()

    def read(self, at: int, size: int) -> bytes:
        """Fewer bytes, or none, past the end of the file."""
        size = min(size, self.size - at)
        if size <= 0:
            return b""
        if at + size <= len(self.first):
            return self.first[at : at + size]
        self.stream.seek(at)
        return self.stream.read(size)


class Whole:
    """The same for a file that is in memory."""

    def __init__(self, body: bytes):
        self.body = body

    def read(self, at: int, size: int) -> bytes:
        return self.body[at : at + size]


def _folder(file: Ranges | Whole, start: int, header: Header, offset: int) -> dict:
    """Known entries of one IFD as text; several numbers are joined by blanks, fractions divided."""
    out = {}
    order, wide = header.order, "HHQ" if header.big else "HHI"
    entry, inline, pointer = (20, 8, "Q") if header.big else (12, 4, "I")
    head = 8 if header.big else 2
    (count,) = struct.unpack(order + ("Q" if header.big else "H"), file.read(start + offset, head))
    entries = file.read(start + offset + head, entry * min(count, MOST_ENTRIES))
    for at in range(0, len(entries) - entry + 1, entry):
        tag, kind, n = struct.unpack_from(order + wide, entries, at)
        size = TYPE_SIZES.get(kind, 0) * n
        value = at + entry - inline
        if tag == PREVIEW and header.magic == RW2_MAGIC:
            out[tag] = str(struct.unpack_from(order + pointer, entries, value)[0])
        if tag not in KNOWN or not 0 < size <= VALUE_BYTES:
            continue
        if size <= inline:
            raw = entries[value : value + size]
        else:
            raw = file.read(start + struct.unpack_from(order + pointer, entries, value)[0], size)
        if len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (5, 10):
            parts = struct.unpack(order + ("II" if kind == 5 else "ii") * n, raw)
            out[tag] = " ".join(repr(p / q) if q else "nan" for p, q in zip(parts[::2], parts[1::2]))
        else:
            out[tag] = " ".join(map(str, struct.unpack(order + NUMBERS[kind] * n, raw)))
    return out


def _block_tags(file: Ranges | Whole, block: Block) -> dict[str, str]:
    """Named tags of one TIFF structure; damaged parts are left out."""
    header = tiff_header(file, block.start)
    if header is None:
        return {}
    folders = {"main": {}, "shot": {}, "gps": {}}
    try:
        folders[block.role] = first = _folder(file, block.start, header, header.offset)
        for role, link in (("shot", SHOT_FOLDER), ("gps", GPS_FOLDER)):
            if link in first and role != block.role:
                folders[role] = _folder(file, block.start, header, int(first[link]))
    except (struct.error, ValueError):
        pass
    main, shot, gps = folders.values()
    found = {name: main.get(tag) for tag, name in MAIN_TAGS.items()}
    found |= {name: shot.get(tag, main.get(tag)) for tag, name in (SHOT_TAGS | MORE_TAGS).items()}
    found |= {name: gps.get(tag) for tag, name in GPS_TAGS.items()}
    if header.magic == RW2_MAGIC:
        found["iso"] = found["iso"] or main.get(RW2_ISO)
        preview = jpeg_block(file, block.start + int(main[PREVIEW])) if PREVIEW in main else None
        if preview is not None:  # such files may keep the shot in their preview only
            more = _block_tags(file, Block("main", preview))
            found = more | {k: v for k, v in found.items() if v is not None}
    return {k: v for k, v in found.items() if v is not None}


def header_tags(body: bytes | Ranges) -> dict[str, str]:
    """Known tags of a file of any container in `containers`; damaged parts are left out.

    Folders and values are followed wherever in the file they stand. Shot tags may also stand in the main folder.
    A value of over 16 MB is taken as damaged and not read. Of several structures the first that has a tag gives it.
    """
    file = body if isinstance(body, Ranges) else Whole(body)
    out: dict[str, str] = {}
    for block in find_blocks(file):
        out = _block_tags(file, block) | out
    if "model" not in out and (name := raf_model(file)):
        out["model"] = name
    return movie_tags(file) | out


def extract_tags(files: DataFrame, path="path", content="content", header_bytes: int | None = None) -> DataFrame:
    """File bytes -> one row per tag found: path, tag, value (text).

    `header_bytes` passes only the head of each file to Python, for formats that keep all tags there;
    without it the whole file is searched.
    """
    body = F.col(content) if header_bytes is None else F.substring(content, 1, header_bytes)

    def read(batches):
        for batch in batches:
            rows = [(p, t, v) for p, b in zip(batch["path"], batch["body"]) if b is not None for t, v in header_tags(bytes(b)).items()]
            yield pd.DataFrame(rows, columns=["path", "tag", "value"])

    return files.select(F.col(path).alias("path"), body.alias("body")).mapInPandas(read, "path string, tag string, value string")


def _text(c: str) -> Column:
    return F.nullif(strip(F.col(c)), F.lit(""))


def _number(c: str) -> Column:
    first = F.regexp_extract(strip(F.col(c)), r"^(\S+)", 1).try_cast("double")
    return F.when((first > 0) & ~F.isnan(first), first)


def _degrees(value: str, ref: str) -> Column:
    parts = F.split(strip(F.col(value)), r"\s+")
    d, m, s = (F.get(parts, F.lit(i)).try_cast("double") for i in range(3))
    size = d + m / 60.0 + s / 3600.0
    known = F.when(F.col(ref).isNotNull() & ~F.isnan(size), size)
    return F.round(F.when(F.col(ref).rlike("^[SsWw]"), -known).otherwise(known), 6)


def normalise_metadata(tags: DataFrame) -> DataFrame:
    """Tag rows -> path and one `exif` struct; values that are empty, unreadable or not positive are NULL."""
    wide = tags.groupBy("path").pivot("tag", list(TAG_NAMES)).agg(F.max("value"))
    lat, lon = _degrees("lat", "lat_ref"), _degrees("lon", "lon_ref")
    return wide.select(
        "path",
        F.struct(
            _text("make").alias("make"),
            _text("model").alias("model"),
            F.coalesce(F.nullif(_number("orientation").cast("int"), F.lit(0)), F.lit(1)).alias("orientation"),
            *[_number(c).alias(c) for c in ("aperture", "shutter", "iso", "focal_length")],
            F.nullif(F.col("datetime"), F.lit("")).alias("datetime"),
            F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))).alias("gps"),
        ).alias("exif"),
    )


RECORD_COLUMNS = ("DateTimeOriginal", "CreateDate", "MediaCreateDate", "Model", "LensModel", "LensID", "LensSpec", "FocalLength")


def tag_rows(probed: DataFrame, path="path", tags="tags") -> DataFrame:
    """Paths with the tags of each file as a map -> one row per tag found, as `extract_tags` gives."""
    return probed.select(F.col(path).alias("path"), F.explode(tags).alias("tag", "value"))


def metadata_records(probed: DataFrame, path="path", tags="tags") -> DataFrame:
    """Paths with the tags of each file -> one row per path of what `reconcile.file_metadata` asks for."""
    tag = lambda name: F.element_at(tags, name)
    day = lambda name: F.regexp_replace(F.substring(tag(name), 1, 10), ":", "-")
    values = {
        "DateTimeOriginal": day("datetime"),
        "CreateDate": day("create_date"),
        "MediaCreateDate": day(MOVIE_DATE),
        "Model": tag("model"),
        "LensModel": tag("lens_model"),
        "LensID": F.lit(None).cast("string"),
        "LensSpec": tag("lens_spec"),
        "FocalLength": tag("focal_length"),
    }
    return probed.select(F.col(path).alias("path"), *[values[c].alias(c) for c in RECORD_COLUMNS])
