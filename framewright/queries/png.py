"""A PNG writer for rasters derived from the tables; it needs nothing but zlib."""

from __future__ import annotations

import struct
import zlib


def png_file(height: int, width: int, bgr: bytes) -> bytes:
    """8-bit colour PNG of interleaved BGR bytes."""
    rows = [bgr[y * width * 3 : (y + 1) * width * 3] for y in range(height)]
    raw = b"".join(b"\0" + b"".join(r[i : i + 3][::-1] for i in range(0, len(r), 3)) for r in rows)
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def deep_png(values, colour: int, filters: tuple[int, ...], interlaced: bool = False) -> bytes:
    """16-bit PNG of `values` (rows x columns x channels), whose rows take the given filters in turn."""
    height, width, channels = values.shape

    def rows(part) -> bytes:
        step, above, out = 2 * channels, bytes(part.shape[1] * 2 * channels), b""
        for y in range(len(part)):
            line, kind = part[y].astype(">u2").tobytes(), filters[y % len(filters)]
            left = bytes(step) + line[:-step]
            corner = bytes(step) + above[:-step]
            guesses = {
                0: lambda a, b, c: 0,
                1: lambda a, b, c: a,
                2: lambda a, b, c: b,
                3: lambda a, b, c: (a + b) // 2,
                4: lambda a, b, c: min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2],
            }
            out += bytes([kind]) + bytes((v - guesses[kind](*g)) % 256 for v, *g in zip(line, left, above, corner))
            above = line
        return out

    steps = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if interlaced else ((0, 0, 1, 1),)
    parts = [values[y::dy, x::dx] for x, y, dx, dy in steps]
    raw = b"".join(rows(p) for p in parts if p.size)
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    head = struct.pack(">IIBBBBB", width, height, 16, colour, 0, 0, int(interlaced))
    packed = zlib.compress(raw)
    body = chunk(b"IDAT", packed[: len(packed) // 2]) + chunk(b"IDAT", packed[len(packed) // 2 :])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + body + chunk(b"IEND", b"")
