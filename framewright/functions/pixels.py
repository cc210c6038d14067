"""Pixel passes over one analysis image (numpy, inside a Spark task).

Each function returns counts, sums or small vectors; every statistic built on them is a column
expression (`operators.measures.derive_measures`). Borders reflect without repeating the edge.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ANGLE_BINS = 48
LOW_BAND = (0.04, 0.10)
HIGH_BAND = (0.15, 0.40)
LAG_GRID = 8
LAGS = ((0, 1), (1, 0), (1, 1), (-1, 1))  # (rows, columns)
CORNER_GRID = 4


def decode_plane(data, height: int, width: int, channels: int) -> np.ndarray:
    """Raw bytes of the image source -> H x W x 3 BGR (grey is repeated, alpha dropped)."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(a, 3, axis=2)
    return a[:, :, :3]


def orient(image: np.ndarray, orientation: int) -> np.ndarray:
    """Upright pixels for the EXIF orientations 1-8 as the standard defines them."""
    if orientation in (5, 6, 7, 8):
        image = np.swapaxes(image, 0, 1)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return image


def _area_axis(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over `size` equal, possibly fractional, intervals of axis 0."""
    n = a.shape[0]
    total = np.concatenate([np.zeros((1,) + a.shape[1:]), np.cumsum(a, axis=0, dtype=np.float64)])
    edge = np.arange(size + 1) * (n / size)
    whole = np.minimum(edge.astype(np.int64), n - 1)
    part = (edge - whole).reshape((-1,) + (1,) * (a.ndim - 1))
    at_edge = total[whole] + part * a[whole]
    return np.diff(at_edge, axis=0) * (size / n)


def area_downsample(image: np.ndarray, longest: int) -> np.ndarray:
    h, w = image.shape[:2]
    if max(h, w) <= longest:
        return image
    scale = longest / max(h, w)
    rows, cols = max(1, int(h * scale)), max(1, int(w * scale))
    shrunk = _area_axis(image.astype(np.float64), rows)
    shrunk = np.swapaxes(_area_axis(np.swapaxes(shrunk, 0, 1), cols), 0, 1)
    return np.clip(np.rint(shrunk), 0, 255).astype(np.uint8)


def laplacian(green: np.ndarray) -> np.ndarray:
    p = np.pad(green.astype(np.int32), 1, mode="reflect")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def sobel(plane: np.ndarray, border: str = "reflect") -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(plane.astype(np.int32), 1, mode=border)
    across = p[:-2] + 2 * p[1:-1] + p[2:]
    down = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return across[:, 2:] - across[:, :-2], down[2:] - down[:-2]


def cell_views(a: np.ndarray, cells: int) -> np.ndarray:
    """(cells*cells, cell pixels) copy of the grid; remainder rows and columns stay unused."""
    h, w = a.shape[0] // cells, a.shape[1] // cells
    cut = a[: h * cells, : w * cells].reshape(cells, h, cells, w)
    return cut.transpose(0, 2, 1, 3).reshape(cells * cells, h, w)


def block_variances(lap: np.ndarray, cells: int) -> np.ndarray:
    h, w = lap.shape
    if h >= cells and w >= cells:
        return cell_views(lap, cells).reshape(cells * cells, -1).var(axis=1, dtype=np.float64)
    # Fewer pixels than cells on a side: cells of at least one pixel, and those without any carry no signal.
    row, column = (np.arange(n) // max(1, n // cells) for n in (h, w))
    inside = np.ix_(row < min(cells, h), column < min(cells, w))
    cell = (row[:, None] * cells + column[None, :])[inside].ravel()
    value = lap[inside].ravel().astype(np.float64)
    n, total, squares = (np.bincount(cell, v, cells * cells) for v in (np.ones_like(value), value, value * value))
    return (n * squares - total * total) / np.maximum(n, 1) ** 2


def cumulative_counts(plane: np.ndarray) -> np.ndarray:
    return np.cumsum(np.bincount(plane.ravel(), minlength=256))


def blur_residual(green: np.ndarray) -> np.ndarray:
    p = np.pad(green.astype(np.int32), 1, mode="reflect")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    smooth = (rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:] + 8) >> 4
    return np.abs(green.astype(np.int32) - smooth)


def channel_extremes(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest and lowest channel of every pixel."""
    b, g, r = bgr[:, :, 0], bgr[:, :, 1], bgr[:, :, 2]
    return np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)


def _saturation_table() -> np.ndarray:
    """8-bit HSV saturation by (highest, spread), with the 12-bit fixed-point division usual for it."""
    share = np.zeros(256, dtype=np.int64)
    share[1:] = np.rint((255 << 12) / np.arange(1, 256))
    return (np.arange(256)[None, :] * share[:, None] + 2048) >> 12


def saturation_total(highest: np.ndarray, lowest: np.ndarray) -> int:
    """Sum of the saturation over all pixels, from how often each (highest, spread) occurs."""
    pairs = highest.astype(np.int32) * 256 + (highest - lowest)
    return int((np.bincount(pairs.ravel(), minlength=65536) * _saturation_table().ravel()).sum())


def corner_means(green: np.ndarray) -> tuple[float, float]:
    h, w = green.shape
    ch, cw = max(1, h // 10), max(1, w // 10)
    rows = (slice(0, ch), slice(h - ch, h))
    cols = (slice(0, cw), slice(w - cw, w))
    corners = float(np.mean([green[r, c].mean() for r in rows for c in cols]))
    centre = green[h // 4 : h * 3 // 4, w // 4 : w * 3 // 4]
    return corners, float(centre.mean()) if centre.size else 0.0


def corner_response(green: np.ndarray) -> np.ndarray:
    """Harris response: window 5, Sobel 3, k 0.04, gradients scaled for 8-bit input.

    Window sums stay in 32-bit integers (at most 25 * 1020 squared), so they are exact.
    """
    gx, gy = sobel(green)
    h, w = green.shape

    def window_sum(a):
        p = np.pad(a, 2, mode="reflect")
        rows = p[0:h] + p[1 : h + 1] + p[2 : h + 2] + p[3 : h + 3] + p[4 : h + 4]
        return rows[:, 0:w] + rows[:, 1 : w + 1] + rows[:, 2 : w + 2] + rows[:, 3 : w + 3] + rows[:, 4 : w + 4]

    scale = (4.0 * 5.0 * 255.0) ** 2
    xx, xy, yy = (window_sum(a) / scale for a in (gx * gx, gx * gy, gy * gy))
    return xx * yy - xy * xy - 0.04 * (xx + yy) ** 2


def corner_counts(green: np.ndarray, minimum: float) -> tuple[int, np.ndarray]:
    """Corners in the image and in each of 4 x 4 cells; too small an image has none at all."""
    if green.size < 64:
        return 0, np.zeros(CORNER_GRID**2, dtype=np.int64)
    found = corner_response(green) > minimum
    cells = cell_views(found, CORNER_GRID) if min(green.shape) >= CORNER_GRID else np.zeros((16, 1, 1), bool)
    return int(found.sum()), cells.sum(axis=(1, 2))


@lru_cache(8)
def _spectrum_places(h: int, w: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Window of a raster size and, for either radial band, its frequencies (flat) and their angle bins.

    Bin k holds angles in radians from k to k + 1 parts, upper end included, as the calibrated thresholds
    expect; what is beyond the last bin falls into it.
    """
    fx, fy = np.meshgrid(np.fft.rfftfreq(w), np.fft.fftfreq(h))
    radius, angle = np.hypot(fx, fy).ravel(), (np.arctan2(fy, fx) % np.pi).ravel()
    places = []
    for low, high in (LOW_BAND, HIGH_BAND):
        at = np.flatnonzero((radius >= low) & (radius <= high))
        edges = np.arange(ANGLE_BINS) / ANGLE_BINS
        places.append((at, np.maximum(np.searchsorted(edges, angle[at], "left") - 1, 0)))
    return np.hanning(h)[:, None] * np.hanning(w), places


def band_energies(green: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Power per angle bin in the low and the high radial band of the windowed spectrum."""
    window, places = _spectrum_places(*green.shape)
    power = np.abs(np.fft.rfft2((green - green.mean()) * window)).ravel() ** 2
    low, high = (np.bincount(bins, power[at], ANGLE_BINS) for at, bins in places)
    return low, high


def lag_energies(green: np.ndarray) -> np.ndarray:
    """Mean squared difference per cell (8 x 8) and direction, flat with direction last.

    The whole plane is shifted by the lag; pixels whose partner lies in another cell do not count, and a
    lag that leaves fewer than two rows or columns of a cell counts for nothing.
    """
    h, w = (n // LAG_GRID for n in green.shape)
    out = np.zeros((LAG_GRID, LAG_GRID, len(LAGS)))
    if not h or not w:
        return out.ravel()
    plane = green[: h * LAG_GRID, : w * LAG_GRID].astype(np.float64)
    row, column = np.arange(h), np.arange(w)
    for d, (dy, dx) in enumerate(LAGS):
        rows, columns = (row - dy >= 0) & (row - dy < h), (column - dx >= 0) & (column - dx < w)
        if min(rows.sum(), columns.sum()) < 2:
            continue
        squares = (plane - np.roll(plane, (dy, dx), (0, 1))) ** 2
        cells = squares.reshape(LAG_GRID, h, LAG_GRID, w)[:, rows][:, :, :, columns]
        out[:, :, d] = cells.sum((1, 3)) / (rows.sum() * columns.sum())
    return out.ravel()


def edge_pixels(green: np.ndarray, low: int, high: int) -> int:
    """Canny (1986): Sobel, thinning across the gradient, hysteresis over 8 neighbours."""
    low, high = min(low, high), max(low, high)
    gx, gy = sobel(green, border="edge")
    m = np.pad(np.abs(gx) + np.abs(gy), 1)
    h, w = green.shape
    at = lambda dy, dx: m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    ax, ay = np.abs(gx).astype(np.float64), np.abs(gy).astype(np.float64)
    flat, steep = ay < ax * np.tan(np.pi / 8), ay > ax * np.tan(3 * np.pi / 8)
    falling = (gx < 0) != (gy < 0)
    mid = at(0, 0)
    thin_flat = (mid > at(0, -1)) & (mid >= at(0, 1))
    thin_steep = (mid > at(-1, 0)) & (mid >= at(1, 0))
    thin_down = (mid > at(-1, -1)) & (mid > at(1, 1))
    thin_up = (mid > at(-1, 1)) & (mid > at(1, -1))
    thin = np.where(flat, thin_flat, np.where(steep, thin_steep, np.where(falling, thin_up, thin_down)))
    candidate = np.pad(thin & (mid > low), 1)
    unseen, width = candidate.ravel().copy(), w + 2
    front = np.flatnonzero(candidate & np.pad(mid > high, 1))
    steps = np.array([-width - 1, -width, -width + 1, -1, 1, width - 1, width, width + 1])
    while front.size:
        unseen[front] = False
        near = (front[:, None] + steps).ravel()
        front = np.unique(near[unseen[near]])
    return int(candidate.sum() - unseen.sum())
