"""Rasters of more than 8 bits a channel: written as PNG and TIFF files of several kinds, decoded and reduced."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framewright.functions import names
from framewright.queries.base import query, spread_files, table
from framewright.queries.png import deep_png
from framewright.sources import files
from framewright.sources.shared import shared_folder


def lzw(body: bytes) -> bytes:
    """TIFF's LZW: the table is cleared before it is full."""
    out = bits = held = 0
    packed, known, size, now = bytearray(), {}, 9, b""

    def put(code):
        nonlocal held, bits
        held, bits = (held << size) | code, bits + size
        while bits >= 8:
            bits -= 8
            packed.append(held >> bits & 255)

    put(256)
    for b in body:
        longer = now + bytes([b])
        if len(longer) == 1 or longer in known:
            now = longer
            continue
        put(known[now] if len(now) > 1 else now[0])
        known[longer] = 258 + len(known)
        if known[longer] == 4093:
            put(256)
            known, size = {}, 9
        elif known[longer] + 1 >= 1 << size:
            size += 1
        now = bytes([b])
    if now:
        put(known[now] if len(now) > 1 else now[0])
        if 258 + len(known) + 1 >= 1 << size and size < 12:
            size += 1
    put(257)
    if bits:
        packed.append(held << (8 - bits) & 255)
    return bytes(packed)


def pack_bits(body: bytes) -> bytes:
    """Runs of up to 128 equal bytes as two, everything else in literal runs."""
    out, at = bytearray(), 0
    while at < len(body):
        n = 1
        while at + n < len(body) and n < 128 and body[at + n] == body[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, body[at]])
        else:
            while at + n < len(body) and n < 128 and (at + n + 1 >= len(body) or body[at + n] != body[at + n + 1]):
                n += 1
            out += bytes([n - 1]) + body[at : at + n]
        at += n
    return bytes(out)


def tiff_file(values: np.ndarray, order: str = "<", compression: int = 1, differences: bool = False, tile: int = 0, rows: int = 3, planar: bool = False) -> bytes:
    """A TIFF of rows x columns x channels, in strips of `rows` rows or square tiles, pixels before the folder."""
    height, width, channels = values.shape
    kind = values.dtype.newbyteorder(order)
    pack = {1: bytes, 5: lzw, 8: zlib.compress, 32773: pack_bits}[compression]
    parts = []
    for plane in [values[:, :, k : k + 1] for k in range(channels)] if planar else [values]:
        tall, wide = (tile, tile) if tile else (rows, width)
        for y in range(0, height, tall):
            for x in range(0, width, wide):
                part = plane[y : y + tall, x : x + wide]
                if tile:
                    part = np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1]), (0, 0)), mode="edge")
                if differences:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                parts.append(pack(np.ascontiguousarray(part).astype(kind).tobytes()))
    body, offsets = b"", []
    for part in parts:
        offsets.append(8 + len(body))
        body += part + b"\0" * (len(part) % 2)
    layout = [(322, [tile]), (323, [tile]), (324, offsets), (325, list(map(len, parts)))] if tile else [(273, offsets), (278, [rows]), (279, list(map(len, parts)))]
    facts = [
        (256, [width]), (257, [height]), (258, [values.dtype.itemsize * 8] * channels), (259, [compression]), (262, [2 if channels == 3 else 1]),
        (277, [channels]), (284, [2 if planar else 1]), (317, [2 if differences else 1]), (339, [3 if values.dtype.kind == "f" else 1] * channels), *layout,
    ]
    cells, at = b"", 8 + len(body)
    for tag, numbers in sorted(facts):
        packed = struct.pack(f"{order}{len(numbers)}I", *numbers)
        if len(numbers) > 1:
            cells += struct.pack(order + "HHII", tag, 4, len(numbers), at)
            body += packed
            at += len(packed)
        else:
            cells += struct.pack(order + "HHI", tag, 4, 1) + packed
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    return head + body + struct.pack(order + "H", len(facts)) + cells + struct.pack(order + "I", 0)


def deep_file(k: int, grey: np.ndarray) -> tuple[str, bytes]:
    """An 8 x 8 raster of 16 bits as one of eight kinds of file; colours are the grey values, inverted and halved."""
    colour = np.concatenate([grey, 65535 - grey, grey // 2], axis=2).astype(np.uint16)
    kinds = (
        ("png", lambda: deep_png(grey, 0, (0, 1, 2))),
        ("png", lambda: deep_png(colour, 2, (4, 3, 1, 2, 0))),
        ("png", lambda: deep_png(colour, 2, (3, 4), interlaced=True)),
        ("tif", lambda: tiff_file(grey)),
        ("tif", lambda: tiff_file(colour, ">", 5, differences=True)),
        ("tif", lambda: tiff_file(colour, "<", 32773, tile=16)),
        ("tiff", lambda: tiff_file(colour, ">", 8, differences=True, planar=True)),
        ("tiff", lambda: tiff_file(grey, ">", 5, tile=16)),
    )
    ending, make = kinds[k % len(kinds)]
    return f"{k:08d}.{ending}", make()


@query(
    "s2_deep_rasters",
    """WITH v AS (SELECT vec_id, i, greatest(0, least(65535, CAST(floor((CAST(embedding[i] AS DOUBLE) + 0.5) * 40000) AS BIGINT))) AS d FROM embeddings, range(1, 65) t(i)),
    w AS (SELECT *, vec_id % 8 IN (0, 3, 7) AS grey FROM v)
    SELECT printf('%08d.', vec_id) || ['png', 'png', 'png', 'tif', 'tif', 'tif', 'tiff', 'tiff'][vec_id % 8 + 1] AS name, 8 AS height, 8 AS width,
      CASE WHEN grey THEN 1 ELSE 3 END AS n_channels, 'more than 8 bits per channel: reduced to 8' AS load_note,
      sha256(string_agg(CASE WHEN grey THEN printf('%02X', d >> 8) ELSE printf('%02X%02X%02X', (d // 2) >> 8, (65535 - d) >> 8, d >> 8) END, '' ORDER BY i)) AS pixels
    FROM w GROUP BY vec_id, grey""",
)
def s2_deep(spark, sf):
    """Embeddings as 16-bit files, filtered, interlaced, compressed, in strips and tiles; pixels as the depth rule has them."""

    def encode(batches):
        for batch in batches:
            rows = [deep_file(k, np.asarray(d, np.uint16).reshape(8, 8, 1)) for k, d in zip(batch["vec_id"], batch["d"])]
            yield pd.DataFrame(rows, columns=["name", "content"])

    root = shared_folder(spark, "deep")
    number = lambda x: F.greatest(F.lit(0), F.least(F.lit(65535), F.floor((x.cast("double") + 0.5) * 40000))).cast("int")
    wide = spread_files(table(spark, sf, "embeddings"), "vec_id").select("vec_id", F.transform("embedding", number).alias("d"))
    files.land_files(wide.mapInPandas(encode, "name string, content binary"), root).write.format("noop").mode("overwrite").save()
    found = files.load_rasters(spark, root).filter("not is_error")
    return found.select(names.base_name("path").alias("name"), "height", "width", "n_channels", "load_note", F.sha2(F.hex("data"), 256).alias("pixels"))
