"""File-name and folder-name expressions (all JVM-side string functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension sets, forbidden characters, camera file-name patterns.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".gif", ".webp")
MEDIA_EXTENSIONS = (
    ".cr3", ".cr2", ".arw", ".nef", ".dng", ".raf", ".orf", ".rw2",
    ".jpg", ".jpeg", ".mp4", ".mov",
)
VIDEO_EXTENSIONS = (".mp4", ".mov")
FORBIDDEN_CHARACTERS = '<>:"/\\|?*'
CAMERA_NAME_PATTERN = r"(?i)^(image\d+|IMG_\d+|DSC_\d+|_MG_\d+|P\d{4,}|\d{4,})"

# What counts as white space at the ends of a text (ASCII controls and Unicode spaces).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value, use) -> Column:
    """`use(value)` with the value worked out once, however often `use` names it.

    Written out, such a value is repeated wherever it is named, and a projection of many of them becomes one method that
    is too long for the JVM to compile; with a lambda it is made in short ones.
    """
    return F.transform(F.array(_col(value)), use)[0]


def base_name(path) -> Column:
    """Part after the last slash or backslash, found by delimiter and not by pattern (linear in the length)."""
    return F.substring_index(F.substring_index(_col(path), "/", -1), "\\", -1)


def folder(path) -> Column:
    kept = F.length(_col(path)) - F.length(base_name(path)) - 1
    return F.substring(_col(path), F.lit(1), F.greatest(kept, F.lit(0)))


def suffix(path) -> Column:
    """Last extension with its dot, '' for none; leading dots start a hidden name, not a suffix."""
    return bound(base_name(path), _suffix)


def _suffix(name: Column) -> Column:
    tail = F.substring_index(name, ".", -1)
    head = F.substring(name, F.lit(1), F.greatest(F.length(name) - F.length(tail) - 1, F.lit(0)))
    real = (tail != "") & (F.ltrim(head, F.lit(".")) != "")
    return F.when(real, F.concat(F.lit("."), tail)).otherwise("")


def stem(path) -> Column:
    return bound(base_name(path), lambda name: F.substring(name, F.lit(1), F.length(name) - F.length(_suffix(name))))


def has_extension(path, extensions) -> Column:
    return F.lower(suffix(path)).isin([e.lower() for e in extensions])


def strip(text) -> Column:
    return F.btrim(_col(text), F.lit(WHITE_SPACE))


def sanitize_part(text) -> Column:
    safe = F.translate(F.coalesce(_col(text), F.lit("")), FORBIDDEN_CHARACTERS, "_" * len(FORBIDDEN_CHARACTERS))
    return F.rtrim(strip(safe), F.lit("."))


def format_focal(raw) -> Column:
    """'35,0 mm' -> '35mm'; non-integers keep six significant digits; other text is only sanitised."""
    text = F.translate(strip(F.coalesce(_col(raw).cast("string"), F.lit(""))), ",", ".")
    bare = strip(F.regexp_replace(text, r"(?i)\s*mm$", ""))
    token = F.regexp_extract(bare, r"^(\S*)", 1)
    number = F.when(token.rlike(_NUMBER), token.try_cast("double"))
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(number))))
    shown = (
        F.when(number == F.floor(number), number.try_cast("bigint").cast("string"))
        .otherwise((F.rint(number * scale) / scale).cast("string"))
    )
    return F.when(number.isNotNull(), F.concat(shown, F.lit("mm"))).otherwise(sanitize_part(token))


def media_kind(path) -> Column:
    return F.when(has_extension(path, VIDEO_EXTENSIONS), "video").otherwise("photo")


def camera_base(name) -> Column:
    """Identity shared by the developed and the raw file of one exposure, in upper case."""
    bare = stem(name)
    known = F.regexp_extract(bare, CAMERA_NAME_PATTERN, 1)
    return F.upper(F.coalesce(F.nullif(known, F.lit("")), F.substring_index(bare, "_", 2)))


def join_path(*parts) -> Column:
    return F.concat_ws("/", *[_col(p) for p in parts])


def numbered(stem_col, suffix_col, number) -> Column:
    """name.ext for 0, name_1.ext for 1, ..."""
    n = _col(number)
    return F.concat(
        _col(stem_col),
        F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(F.lit("")),
        _col(suffix_col),
    )
