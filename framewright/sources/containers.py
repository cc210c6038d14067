"""Where the metadata of a file stands: the containers of photos, raw photos and movies.

Nothing here reads a file whole. A container is stepped through by its own headers, and what comes back are the places of
the TIFF structures inside it, or, for movies, the few texts and dates of their header boxes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import NamedTuple

# Names and numbers of the formats.
TIFF_MAGIC = {42, 0x4F52, 0x5352, 0x55}  # TIFF; the two of ORF; RW2
BIG_TIFF_MAGIC = 43
RW2_MAGIC = 0x55
RAF_HEAD = b"FUJIFILMCCD-RAW "
RAF_MODEL, RAF_PREVIEW = 28, 84  # places in the RAF header: name of the model, then offset and size of the preview
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
CANON_BOX = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")  # `uuid` box of CR3
CANON_PARTS = {b"CMT1": "main", b"CMT2": "shot", b"CMT4": "gps"}
MOVIE_PARTS = {b"\xa9mak": "make", b"\xa9mod": "model"}
MOVIE_KEYS = {
    "com.apple.quicktime.make": "make",
    "com.apple.quicktime.model": "model",
    "com.apple.quicktime.camera.lens_model": "lens_model",
    "com.android.manufacturer": "make",
    "com.android.model": "model",
}
MOVIE_EPOCH = datetime(1904, 1, 1)  # dates in movie headers count seconds from here

TEXT_BYTES = 1 << 16  # a longer text of a movie header is damaged
MOST_BOXES = 100_000  # boxes of one file that are stepped over


class Header(NamedTuple):
    order: str  # of bytes, as `struct` has it
    big: bool  # 64-bit offsets
    offset: int  # of the first folder
    magic: int


class Block(NamedTuple):
    role: str  # which folder the structure holds: main (with links to the others), shot or gps
    start: int


def tiff_header(file, start: int = 0) -> Header | None:
    """The header of a TIFF structure at `start`, also of its variants in raw formats."""
    head = file.read(start, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        return None
    (magic,) = struct.unpack_from(order + "H", head, 2)
    if magic in TIFF_MAGIC:
        return Header(order, False, struct.unpack_from(order + "I", head, 4)[0], magic)
    if magic == BIG_TIFF_MAGIC and len(head) == 16 and struct.unpack_from(order + "HH", head, 4) == (8, 0):
        return Header(order, True, struct.unpack_from(order + "Q", head, 8)[0], magic)
    return None


def jpeg_block(file, at: int = 0) -> int | None:
    """Start of the TIFF structure in the Exif segment of a JPEG stream that begins at `at`."""
    if file.read(at, 2) != b"\xff\xd8":
        return None
    at += 2
    while True:
        b = file.read(at, 10)
        while len(b) > 1 and b[:2] == b"\xff\xff":  # fill bytes may stand before a marker
            at += 1
            b = file.read(at, 10)
        if len(b) < 4 or b[0] != 0xFF or b[1] == 0xDA:
            return None
        if b[1] == 0xE1 and b[4:] == b"Exif\0\0":
            return at + 10
        at += 2 + max(2, int.from_bytes(b[2:4], "big"))


def png_block(file) -> int | None:
    """Start of the TIFF structure in the `eXIf` chunk of a PNG file, wherever that stands."""
    at = len(PNG_HEAD)
    for _ in range(MOST_BOXES):
        head = file.read(at, 8)
        if len(head) < 8 or head[4:] == b"IEND":
            return None
        if head[4:] == b"eXIf":
            return at + 8
        at += 12 + int.from_bytes(head[:4], "big")
    return None


def boxes(file, at: int, end: int | None) -> Iterator[tuple[bytes, int, int | None]]:
    """(kind, start of the body, end) of the boxes of ISO media between two places; `end` None is the end of the file."""
    for _ in range(MOST_BOXES):
        head = file.read(at, 16)
        if len(head) < 8 or (end is not None and at + 8 > end):
            return
        size, kind, body = int.from_bytes(head[:4], "big"), head[4:8], at + 8
        if size == 1:
            size, body = int.from_bytes(head[8:16], "big"), at + 16
        stop = end if size == 0 else at + size
        if stop is not None and (stop < body or (end is not None and stop > end)):
            return
        yield kind, body, stop
        if stop is None:
            return
        at = stop


def is_media(file) -> bool:
    """Whether the file is made of ISO media boxes."""
    return file.read(4, 4) in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip", b"pnot")


def canon_blocks(file, at: int, end: int | None) -> list[Block]:
    """The TIFF structures that CR3 keeps in its own box of the movie header, one for each folder."""
    found = []
    for kind, body, stop in boxes(file, at, end):
        if kind == b"uuid" and file.read(body, 16) == CANON_BOX:
            found += [Block(CANON_PARTS[k], b) for k, b, _ in boxes(file, body + 16, stop) if k in CANON_PARTS]
    return found


def find_blocks(file) -> list[Block]:
    """All TIFF structures of a file, the most telling first; none for a file of another kind.

    TIFF and BigTIFF, ORF and RW2 begin with one; JPEG has it in a segment, PNG in a chunk, RAF in the JPEG preview
    that its header points to, CR3 in boxes.
    """
    head = file.read(0, 16)
    if tiff_header(file):
        return [Block("main", 0)]
    at = None
    if head[:2] == b"\xff\xd8":
        at = jpeg_block(file)
    elif head[:8] == PNG_HEAD:
        at = png_block(file)
    elif head == RAF_HEAD:
        place = file.read(RAF_PREVIEW, 4)
        at = jpeg_block(file, int.from_bytes(place, "big")) if len(place) == 4 else None
    elif is_media(file):
        return [b for kind, body, stop in boxes(file, 0, None) if kind == b"moov" for b in canon_blocks(file, body, stop)]
    return [] if at is None else [Block("main", at)]


def raf_model(file) -> str | None:
    """The model that the header of a RAF file names."""
    name = file.read(RAF_MODEL, 32).split(b"\0")[0].decode("ascii", "replace").strip()
    return name if file.read(0, 16) == RAF_HEAD and name else None


def _date(file, body: int) -> str | None:
    """Creation date of a `mvhd` or `mdhd` box."""
    head = file.read(body, 12)
    if len(head) < 12:
        return None
    seconds = int.from_bytes(head[4:12] if head[:1] == b"\1" else head[4:8], "big")
    return (MOVIE_EPOCH + timedelta(seconds=seconds)).strftime("%Y:%m:%d %H:%M:%S") if 0 < seconds < 2**33 else None


def _user_text(file, body: int, stop: int | None) -> str | None:
    """A text of the `udta` box: its size, a language and the bytes."""
    head = file.read(body, 4)
    size = int.from_bytes(head[:2], "big")
    if len(head) < 4 or stop is None or not 0 < size <= stop - body - 4:
        return None
    return file.read(body + 4, size).decode("utf-8", "replace").strip("\0 ") or None


def _keyed_texts(file, body: int, stop: int | None) -> dict[str, str]:
    """Texts of a `meta` box that names its keys; in mp4 the box has a version before its own boxes, in mov not."""
    start = body if file.read(body + 4, 4) == b"hdlr" else body + 4
    keys: list[str] = []
    out: dict[str, str] = {}
    for kind, at, end in boxes(file, start, stop):
        if kind == b"keys":
            count, at = int.from_bytes(file.read(at + 4, 4), "big"), at + 8
            for _ in range(min(count, 1000)):
                head = file.read(at, 8)
                size = int.from_bytes(head[:4], "big")
                if not 8 <= size <= TEXT_BYTES:
                    break
                keys.append(file.read(at + 8, size - 8).decode("utf-8", "replace"))
                at += size
        elif kind == b"ilst":
            for number, item, item_end in boxes(file, at, end):
                nth = int.from_bytes(number, "big")
                name = MOVIE_KEYS.get(keys[nth - 1]) if 0 < nth <= len(keys) else None
                for what, value, value_end in boxes(file, item, item_end) if name else ():
                    # The kind of the value (1: UTF-8) and a locale come before it.
                    if what == b"data" and value_end is not None and 8 < value_end - value <= TEXT_BYTES and file.read(value, 4) == b"\0\0\0\1":
                        out.setdefault(name, file.read(value + 8, value_end - value - 8).decode("utf-8", "replace").strip("\0 "))
    return {k: v for k, v in out.items() if v}


def movie_tags(file) -> dict[str, str]:
    """make, model, lens_model, create_date (of the movie) and media_create_date (of its first track, else the same) of mov and mp4."""
    out: dict[str, str] = {}

    def note(name: str, value: str | None) -> None:
        if value:
            out.setdefault(name, value)

    def walk(at: int, end: int | None, depth: int) -> None:
        for kind, body, stop in boxes(file, at, end):
            if kind == b"mvhd":
                note("create_date", _date(file, body))
            elif kind == b"mdhd":
                note("media_create_date", _date(file, body))
            elif kind in (b"trak", b"mdia", b"udta") and depth < 6:
                walk(body, stop, depth + 1)
            elif kind in MOVIE_PARTS:
                note(MOVIE_PARTS[kind], _user_text(file, body, stop))
            elif kind == b"meta":
                for name, value in _keyed_texts(file, body, stop).items():
                    note(name, value)

    if is_media(file):
        for kind, body, stop in boxes(file, 0, None):
            if kind == b"moov":
                walk(body, stop, 0)
    note("media_create_date", out.get("create_date"))
    return out
