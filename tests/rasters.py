"""Small generated rasters and a PNG writer that needs nothing but zlib."""

import struct
import zlib

import numpy as np


def png_bytes(image: np.ndarray) -> bytes:
    """8-bit grey (H,W) or BGR (H,W,3), or 16-bit grey, as a PNG file."""
    depth, kind = (16, 0) if image.dtype == np.uint16 else (8, 0 if image.ndim == 2 else 2)
    rows = image[:, :, ::-1] if image.ndim == 3 else image
    raw = b"".join(b"\0" + np.ascontiguousarray(r.astype(">u2") if depth == 16 else r).tobytes() for r in rows)

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def texture(height=96, width=128, seed=0):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 256, (height // 4, width // 4)), np.ones((4, 4))).astype(np.uint8)


def named():
    y, x = np.mgrid[0:96, 0:128]
    noise = texture()
    smear = np.round(np.stack([np.roll(np.random.default_rng(1).integers(0, 256, (96, 128)), s, 1) for s in range(9)]).mean(0))
    clipped = np.full((96, 128), 120)
    clipped[:5] = 255
    clipped[-29:] = 0
    r = np.hypot((y - 48) / 48, (x - 64) / 64)
    subject = np.full((96, 128), 128)
    subject[36:60, 48:80] = noise[36:60, 48:80]
    return {
        "flat": np.full((96, 128), 128),
        "checker": (y + x) % 2 * 255,
        "subject": subject,
        "smear": smear,
        "ramp": x * 2 - x // 64,
        "clipped": clipped,
        "vignette": np.clip(230 * (1 - 0.75 * r), 0, 255),
        "texture": noise,
        "tiny": np.arange(24).reshape(4, 6) * 10,
    }


def bgr(image):
    a = np.asarray(image).astype(np.uint8)
    return np.repeat(a[:, :, None], 3, axis=2) if a.ndim == 2 else a
