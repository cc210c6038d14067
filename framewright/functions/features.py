"""Keypoints that keep their descriptors when an image is turned or zoomed (numpy, inside a task).

Two detectors. `detect_keypoints`: extrema of differences of Gaussians over scales, fitted between pixels, with a dominant
direction and a turned and scaled window of gradient histograms (Lowe 2004). `detect_binary`: maxima of the Hessian's
determinant in a scale space of non-linear diffusion, which keeps edges sharp, with descriptors of single bits from
comparisons of cell means (Alcantarilla et al. 2013), matched by Hamming distance.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

STACK = 1 << 17  # pixels that are worked on at once: small images one above the other, as a call costs more than their pixels
POINTS = 128  # keypoints that are sampled at once

LONGEST = 1024  # pixels of the side from which on an image is halved first
SIGMA, CAMERA_SIGMA, STEPS = 1.6, 0.5, 3  # blur of the first level, of the camera, and levels per octave
CONTRAST, EDGE = 0.04 * 255 / STEPS, 10.0  # least contrast, and most ratio of the curvatures
MOVE = 0.6  # steps from which on a fit starts again at the next pixel: over half, so that it does not go to and fro
SMALLEST = 16  # pixels of the shorter side of the last octave
GRID = 16  # samples of a descriptor window on a side: 4 x 4 cells of 4 x 4
BINS = 36  # of directions
PEAK = 0.8  # part of the strongest direction that another one must reach to count as well

DIFFUSION_LEVELS = 12  # from SIGMA on, three to an octave
HESSIAN_LEAST = 1e-5  # of the scaled determinant, for brightness from 0 to 1
CELLS = (2, 3, 4)  # grids of cells whose means are compared


def halved(image: np.ndarray) -> tuple[np.ndarray, int]:
    """The image in single precision, halved until its longest side is at most LONGEST, and by how much."""
    out, factor = image.astype(np.float32), 1
    while max(out.shape) > LONGEST and min(out.shape) >= 2:
        h, w = out.shape[0] // 2 * 2, out.shape[1] // 2 * 2
        out = (out[0:h:2, 0:w:2] + out[1:h:2, 0:w:2] + out[0:h:2, 1:w:2] + out[1:h:2, 1:w:2]) * np.float32(0.25)
        factor *= 2
    return out, factor


class Rows:
    """Which rows belong to which image, where images of one width stand one above the other in one array."""

    def __init__(self, heights):
        self.heights = np.asarray(heights, np.int64)
        self.first = np.cumsum(self.heights) - self.heights
        self.last = self.first + self.heights - 1
        self.image = np.repeat(np.arange(len(self.heights)), self.heights)
        self.at = np.arange(len(self.image)) - self.first[self.image]  # row within its image
        self.inner = (self.at > 0) & (self.at < self.heights[self.image] - 1)
        self._padded = {}

    def padded(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows with the first and last one of each image repeated r times, and where each image's own ones are, less r."""
        if r not in self._padded:
            heights = self.heights + 2 * r
            first = np.cumsum(heights) - heights
            image = np.repeat(np.arange(len(heights)), heights)
            at = np.arange(len(image)) - first[image] - r
            index = np.clip(at, 0, self.heights[image] - 1) + self.first[image]
            self._padded[r] = index, self.at + first[self.image]
        return self._padded[r]


def _along(a: np.ndarray, kernel: np.ndarray, rows: Rows) -> np.ndarray:
    """Symmetric kernel (middle first) along the first axis; the border of each image is repeated."""
    r = len(kernel) - 1
    index, own = rows.padded(r)
    p = a[index]
    n = len(p) - 2 * r
    out = p[r : r + n] * kernel[0]
    both = np.empty_like(out)
    for k in range(1, r + 1):
        np.add(p[r - k : r - k + n], p[r + k : r + k + n], out=both)
        both *= kernel[k]
        out += both
    return out if len(out) == len(a) else out[own]


def blurred(a: np.ndarray, sigma: float, rows: Rows) -> np.ndarray:
    r = max(1, math.ceil(3.2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(r + 1) / sigma) ** 2)
    kernel = (kernel / (kernel[0] + 2 * kernel[1:].sum())).astype(np.float32)
    return np.ascontiguousarray(_along(np.ascontiguousarray(_along(a, kernel, rows).T), kernel, _columns(a.shape[1])).T)


@lru_cache(64)
def _columns(width: int) -> Rows:
    return Rows([width])


def octaves(image: np.ndarray, rows: Rows):
    """Levels of growing blur, STEPS + 3 of them per octave, with their rows and the numbers of the images that they are of.

    Each octave has half the size of the one before; images that are too small for it are no longer there.
    """
    level, there = blurred(image, math.sqrt(SIGMA**2 - CAMERA_SIGMA**2), rows), np.arange(len(rows.heights))
    while len(there) and level.shape[1] >= SMALLEST:
        levels = [level]
        for k in range(1, STEPS + 3):
            was, now = SIGMA * 2 ** ((k - 1) / STEPS), SIGMA * 2 ** (k / STEPS)
            levels.append(blurred(levels[-1], math.sqrt(now**2 - was**2), rows))
        yield levels, rows, there
        half = (rows.heights + 1) // 2
        stays = half >= SMALLEST
        level = np.ascontiguousarray(levels[STEPS][(rows.at % 2 == 0) & stays[rows.image]][:, ::2])
        rows, there = Rows(half[stays]), there[stays]


def _largest(a: np.ndarray, pick=np.maximum) -> np.ndarray:
    """The largest (or what else is picked) of the 3 x 3 pixels around each that is not on the border."""
    high = pick(pick(a[:-2], a[1:-1]), a[2:])
    return pick(pick(high[:, :-2], high[:, 1:-1]), high[:, 2:])


_BEFORE = ((-1, -1), (-1, 0), (-1, 1), (0, -1))  # neighbours that come first in order


def _extrema(below, here, above, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Places larger, or smaller, than all 26 neighbours; of equal ones side by side the first in order."""
    middle = here[1:-1, 1:-1]
    high = (middle > CONTRAST / 2) & (middle >= _largest(here))
    low = (middle < -CONTRAST / 2) & (middle <= _largest(here, np.minimum))
    ys, xs = np.nonzero((high | low) & rows.inner[1:-1, None])
    ys, xs = ys + 1, xs + 1
    value = here[ys, xs]
    sign = np.sign(value)
    good = np.ones(len(ys), bool)
    for dy, dx in _BEFORE:
        good &= sign * here[ys + dy, xs + dx] < sign * value
    for other in (below, above):
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                near = sign * other[ys + dy, xs + dx]
                good &= (near < sign * value) if other is below else (near <= sign * value)
    return ys[good], xs[good]


def _fitted(dogs: np.ndarray, rows: Rows, s: np.ndarray, y: np.ndarray, x: np.ndarray):
    """Places between pixels and levels where the fitted parabola has its peak: (image, s, y, x, value, level, kept).

    A fit that leads more than MOVE steps away starts again from there, five times at most.
    """
    levels, _, width = dogs.shape
    s, y, x = s.copy(), y.copy(), x.copy()
    image = rows.image[y]
    top, bottom = rows.first[image], rows.last[image]
    kept, offset = np.ones(len(s), bool), np.zeros((len(s), 3))
    value, curve = np.zeros(len(s)), np.zeros((len(s), 3, 3))
    todo = np.arange(len(s))
    for turn in range(5):
        if not len(todo):
            break
        a, b, c = s[todo], y[todo], x[todo]
        at = lambda i, j, k, a=a, b=b, c=c: dogs[a + i, b + j, c + k].astype(np.float64)
        mid = at(0, 0, 0)
        slope = np.stack([at(1, 0, 0) - at(-1, 0, 0), at(0, 1, 0) - at(0, -1, 0), at(0, 0, 1) - at(0, 0, -1)], 1) / 2
        m = np.empty((len(todo), 3, 3))
        m[:, 0, 0] = at(1, 0, 0) + at(-1, 0, 0) - 2 * mid
        m[:, 1, 1] = at(0, 1, 0) + at(0, -1, 0) - 2 * mid
        m[:, 2, 2] = at(0, 0, 1) + at(0, 0, -1) - 2 * mid
        m[:, 0, 1] = m[:, 1, 0] = (at(1, 1, 0) - at(1, -1, 0) - at(-1, 1, 0) + at(-1, -1, 0)) / 4
        m[:, 0, 2] = m[:, 2, 0] = (at(1, 0, 1) - at(1, 0, -1) - at(-1, 0, 1) + at(-1, 0, -1)) / 4
        m[:, 1, 2] = m[:, 2, 1] = (at(0, 1, 1) - at(0, 1, -1) - at(0, -1, 1) + at(0, -1, -1)) / 4
        regular = np.abs(np.linalg.det(m)) > 1e-12
        m[~regular] = np.eye(3)
        step = -np.linalg.solve(m, slope[:, :, None])[:, :, 0]
        offset[todo], curve[todo] = step, m
        value[todo] = mid + 0.5 * (slope * step).sum(1)
        kept[todo] &= regular
        if turn == 4:
            break
        far = (np.abs(step) > MOVE).any(1) & kept[todo] & (np.abs(step) < 1e3).all(1)
        move = np.rint(step[far]).astype(np.int64)
        todo = todo[far]
        new = np.stack([s[todo], y[todo], x[todo]], 1) + move
        low = np.stack([np.ones(len(todo), np.int64), top[todo] + 1, np.ones(len(todo), np.int64)], 1)
        high = np.stack([np.full(len(todo), levels - 1), bottom[todo], np.full(len(todo), width - 1)], 1)
        inside = (new >= low).all(1) & (new < high).all(1)
        kept[todo[~inside]] = False
        todo, new = todo[inside], new[inside]
        s[todo], y[todo], x[todo] = new.T
    kept &= (np.abs(offset) <= MOVE).all(1) & (np.abs(value) >= CONTRAST)
    trace, det = curve[:, 1, 1] + curve[:, 2, 2], curve[:, 1, 1] * curve[:, 2, 2] - curve[:, 1, 2] ** 2
    kept &= (det > 0) & (trace**2 * EDGE < (EDGE + 1) ** 2 * det)
    return image, s + offset[:, 0], y - top + offset[:, 1], x + offset[:, 2], value, s, kept


def _gradients(level: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    gx, gy = np.empty_like(level), np.empty_like(level)
    np.subtract(level[:, 2:], level[:, :-2], out=gx[:, 1:-1])
    gx[:, 0], gx[:, -1] = level[:, 1] - level[:, 0], level[:, -1] - level[:, -2]
    np.subtract(level[2:], level[:-2], out=gy[1:-1])
    gy[rows.first], gy[rows.last] = level[rows.first + 1] - level[rows.first], level[rows.last] - level[rows.last - 1]
    return gx, gy


class Planes:
    """Levels of stacks of images, one after the other, that places are sampled in."""

    def __init__(self):
        self.kept, self.size = [], 0

    def add(self, planes, rows: Rows, image: np.ndarray) -> np.ndarray:
        """Keep planes of one stack and say where the given images of it stand: (start, height, width) of each."""
        width = planes[0].shape[1]
        where = np.stack([self.size + rows.first[image] * width, rows.heights[image], np.full(len(image), width)], 1)
        self.kept.append([p.ravel() for p in planes])
        self.size += planes[0].size
        return where

    def joined(self) -> list[np.ndarray]:
        return [np.concatenate(p) if len(p) > 1 else p[0] for p in zip(*self.kept, strict=True)]


def _sampled(planes, where, y, x):
    """Values of planes at the pixels nearest to the places y, x, and which of those lie inside the image."""
    start, h, w = where
    rows, columns = np.rint(y).astype(np.int64), np.rint(x).astype(np.int64)
    inside = (rows >= 0) & (rows < h) & (columns >= 0) & (columns < w)
    rows *= w
    rows += columns
    at = start + np.where(inside, rows, 0)
    return [p[at] for p in planes], inside


def _positive(angle: np.ndarray) -> np.ndarray:
    """Angles of less than two turns as those from 0 to a whole turn; the same numbers as a remainder, which takes far longer."""
    full = angle.dtype.type(2 * np.pi)
    rest = np.where(angle <= -full, angle + full, angle)
    return np.where(rest < 0, rest + full, rest)


def _pieces(n: int) -> list[slice]:
    """Parts of about POINTS, none of a single one unless there is no other."""
    ends = np.linspace(0, n, max(1, -(-n // POINTS)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(4)
def _window(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of n x n samples from -1 to 1, by rows: (v, u)."""
    step = (np.arange(n) - (n - 1) / 2) / (n / 2)
    v, u = np.meshgrid(step, step, indexing="ij")
    return v.ravel(), u.ravel()


def directed(gx, gy, where, y, x, scale, group) -> tuple[np.ndarray, np.ndarray]:
    """`directions` of places that stand by groups: of each group the first directions, the second ones, those of no gradient."""
    found = [(part.start, *directions(gx, gy, where[part], y[part], x[part], scale[part])) for part in _pieces(len(y))]
    which, angle, turn = (np.concatenate(c) for c in zip(*((a + s, b, c) for s, a, b, c in found), strict=True))
    order = np.lexsort((which, turn, group[which]))
    return which[order], angle[order]


def directions(gx, gy, where, y, x, scale) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, angle, turn): the strongest direction of gradients around each place, and a second one that comes near it.

    `turn` is 0 for the strongest, 1 for the second and 2 for a place without any gradient, which has direction 0.
    """
    v, u = _window(GRID)
    reach = 4.5 * scale[:, None]
    (a, b), inside = _sampled((gx, gy), where.T[:, :, None], y[:, None] + v * reach, x[:, None] + u * reach)
    weight = np.hypot(a, b) * np.exp(-0.5 * ((v * v + u * u) * 9)) * inside * (v * v + u * u <= 1)
    turn = _positive(np.arctan2(b, a)) * (BINS / (2 * np.pi))
    low = np.floor(turn).astype(np.int64)
    part = turn - low
    first = np.arange(len(y))[:, None] * BINS
    bars = np.bincount((first + np.where(low < BINS, low, low - BINS)).ravel(), (weight * (1 - part)).ravel(), len(y) * BINS)
    bars += np.bincount((first + np.where(low + 1 < BINS, low + 1, low + 1 - BINS)).ravel(), (weight * part).ravel(), len(y) * BINS)
    bars = bars.reshape(-1, BINS)
    for _ in range(2):
        bars = (np.roll(bars, 1, 1) + bars + np.roll(bars, -1, 1)) / 3
    left, right = np.roll(bars, 1, 1), np.roll(bars, -1, 1)
    peak = np.where((bars > left) & (bars >= right), bars, 0)
    which, angle = [], []
    best = peak.max(1)
    for n in range(2):
        k = peak.argmax(1)
        rows = np.flatnonzero((peak[np.arange(len(k)), k] > 0) & (peak[np.arange(len(k)), k] >= PEAK * best))
        at, l, m, r = k[rows], left[rows, k[rows]], bars[rows, k[rows]], right[rows, k[rows]]  # noqa: E741
        which.append(rows)
        angle.append((at + 0.5 * (l - r) / np.minimum(l - 2 * m + r, -1e-12)) * (2 * np.pi / BINS))
        if n == 0:
            peak[np.arange(len(k)), k] = 0
    which.append(np.flatnonzero(best == 0))
    angle.append(np.zeros(len(which[2])))
    return np.concatenate(which), np.concatenate(angle), np.repeat(np.arange(3), [len(w) for w in which])


def histograms(gx, gy, where, y, x, scale, angle) -> np.ndarray:
    """4 x 4 cells of 8 directions around each place, in its own direction and scale; shared out between neighbouring bins."""
    v, u = _window(GRID)
    reach, c, s = 6.0 * scale[:, None], np.cos(angle)[:, None], np.sin(angle)[:, None]
    (a, b), inside = _sampled((gx, gy), where.T[:, :, None], y[:, None] + (s * u + c * v) * reach, x[:, None] + (c * u - s * v) * reach)
    weight = np.hypot(a, b) * np.exp(-0.5 * (v * v + u * u) * 4) * inside
    turn = _positive(np.arctan2(b, a) - angle[:, None]) * (8 / (2 * np.pi))
    place = (v[::GRID] + 1) * 2 - 0.5  # of a row or column of samples, in cells, from the middle of the first
    low = np.floor(turn).astype(np.int64)
    part = turn - low
    cell = np.floor(place).astype(np.int64)
    out = np.zeros(len(y) * 128)
    first = np.arange(len(y))[:, None] * 128
    grid = (len(y), GRID, GRID)
    weight = weight.reshape(grid)
    both = [((first + ((low + dt) & 7)).reshape(grid), np.abs(1 - dt - part).reshape(grid)) for dt in (0, 1)]
    near = [np.abs(1 - d - (place - cell)) for d in (0, 1)]
    some = [slice(*np.searchsorted(cell + d, (0, 4))) for d in (0, 1)]
    for dr in (0, 1):
        for dc in (0, 1):
            r, c = some[dr], some[dc]
            held = weight[:, r, c] * (near[dr][r, None] * near[dc][None, c])
            slot = ((cell[r, None] + dr) * 4 + cell[None, c] + dc) * 8
            for bins, share in both:
                out += np.bincount((bins[:, r, c] + slot).ravel(), (held * share[:, r, c]).ravel(), len(out))
    return out.reshape(-1, 128)


def _bytes(d: np.ndarray) -> np.ndarray:
    """Unit length, no part above 0.2, unit length again, as numbers from 0 to 255."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return np.minimum(np.rint(unit(np.minimum(unit(d), 0.2)) * 512), 255).astype(np.uint8)


def stacked(greens):
    """Numbers of images that are worked on together, their pixels one above the other, their rows and how much they were halved.

    Images of one width come together up to STACK pixels; those that are too small for any keypoint not at all.
    """
    small = {}
    for n, green in enumerate(greens):
        image, factor = halved(green)
        if min(image.shape) < SMALLEST:
            continue
        held = small.setdefault((image.shape[1], factor), [])
        if held and sum(i.size for _, i in held) + image.size > STACK:
            yield _stack(held, factor)
            held.clear()
        held.append((n, image))
    for (_, factor), held in small.items():
        yield _stack(held, factor)


def _stack(held, factor: int):
    numbers, images = zip(*held, strict=True)
    return np.array(numbers), np.concatenate(images), Rows([len(i) for i in images]), factor


def _strongest(image: np.ndarray, limit: int) -> np.ndarray:
    """Which of the rows, sorted by image and strength, are among the first `limit` of their image."""
    first = np.searchsorted(image, image)
    return np.arange(len(image)) - first < limit


def detect_keypoints(green: np.ndarray, limit: int):
    """Positions (x, y), strengths, scales, angles and descriptors (128 numbers from 0 to 255) of the strongest `limit` keypoints."""
    return detect_keypoints_of([green], limit)[0]


def detect_keypoints_of(greens, limit: int) -> list[tuple]:
    """`detect_keypoints` of each image; small ones are worked on together."""
    none = np.zeros((0, 2), np.float32), *(np.zeros(0, np.float32) for _ in range(3)), np.zeros((0, 128), np.uint8)
    out = [none] * len(greens)
    for numbers, image, rows, factor in stacked(greens):
        for k, found in zip(numbers, _stack_keypoints(image, rows, factor, limit, none), strict=True):
            out[k] = found
    return out


def _stack_keypoints(image: np.ndarray, rows: Rows, factor: int, limit: int, none: tuple) -> list[tuple]:
    n_images, found, planes = len(rows.heights), [], []
    for o, (levels, held, there) in enumerate(octaves(image, rows)):
        dogs = np.stack([b - a for a, b in zip(levels, levels[1:], strict=False)])
        places = []
        for k in range(1, STEPS + 1):
            ys, xs = _extrema(dogs[k - 1], dogs[k], dogs[k + 1], held)
            places.append((np.full(len(ys), k), ys, xs))
        of, s, y, x, value, level, kept = _fitted(dogs, held, *(np.concatenate(c) for c in zip(*places, strict=True)))
        columns = there[of[kept]], np.full(kept.sum(), o), level[kept], s[kept], y[kept], x[kept], value[kept]
        found.append(np.stack(columns, 1).astype(np.float64))
        planes.append((levels, held, there))
    points = np.concatenate(found) if found else np.zeros((0, 7))
    if not len(points):
        return [none] * n_images
    points = np.unique(points, axis=0)
    points = points[np.lexsort((*points.T[1:6][::-1], -np.abs(points[:, 6]), points[:, 0]))]
    points = points[_strongest(points[:, 0], limit)]
    points = points[np.lexsort((points[:, 2], points[:, 1], points[:, 0]))]  # of each level as they were
    sampled, where = Planes(), np.zeros((len(points), 3), np.int64)
    for o, (levels, held, there) in enumerate(planes):
        for k in range(1, STEPS + 1):
            at = np.flatnonzero((points[:, 1] == o) & (points[:, 2] == k))
            if len(at):
                where[at] = sampled.add(_gradients(levels[k], held), held, np.searchsorted(there, points[at, 0]))
    del planes
    gx, gy = sampled.joined()
    y, x, scale = points[:, 4], points[:, 5], SIGMA * 2 ** (points[:, 3] / STEPS)
    group = (points[:, 0] * 64 + points[:, 1]) * 8 + points[:, 2]
    which, angle = directed(gx, gy, where, y, x, scale, group)
    points, where, y, x, scale = points[which], where[which], y[which], x[which], scale[which]
    d = np.concatenate([_bytes(histograms(gx, gy, where[i], y[i], x[i], scale[i], angle[i])) for i in _pieces(len(y))])
    size = 2.0 ** points[:, 1] * factor
    shift = (factor - 1) / 2  # a halved pixel lies between those that it was made of
    x, y, strength, scale = x * size + shift, y * size + shift, np.abs(points[:, 6]), scale * size
    order = np.lexsort((angle, y, x, -strength, points[:, 0]))
    order = order[_strongest(points[order, 0], limit)]
    facts = [np.stack([x, y], 1)[order].astype(np.float32), *(c[order].astype(np.float32) for c in (strength, scale, angle)), d[order]]
    ends = np.searchsorted(points[order, 0], np.arange(n_images + 1))
    return [tuple(f[a:b] for f in facts) for a, b in zip(ends, ends[1:], strict=False)]


FEATURES = ("kp_x", "kp_y", "kp_response", "kp_scale", "kp_angle", "descriptors")


def packed_keypoints(greens, limit: int) -> list[dict]:
    """`detect_keypoints` of images as cells of one row each; descriptors are 128 bytes each, one after the other."""
    return [
        dict(zip(FEATURES, (xy[:, 0], xy[:, 1], *facts, d.tobytes()), strict=True))
        for xy, *facts, d in detect_keypoints_of(greens, limit)
    ]


# ---- second detector -----------------------------------------------------------------------------


def _contrast(strength: np.ndarray) -> float:
    return max(float(np.percentile(strength[strength > 0], 70)) if (strength > 0).any() else 0.0, 1e-4)


def diffused(image: np.ndarray, rows: Rows):
    """(sigma, level): brightness from 0 to 1 after more and more diffusion that stops at edges.

    Where the gradient exceeds a contrast set by the image's own gradients little flows; each level is reached by explicit
    steps of varied length, whose cycle as a whole is stable though its longest steps alone would not be.
    """
    level = blurred(image / np.float32(255), 1.0, rows)
    gx, gy = (g / 2 for g in _gradients(level, rows))
    strength = np.hypot(gx, gy)
    contrast = [_contrast(strength[a : b + 1]) for a, b in zip(rows.first, rows.last, strict=True)]
    squared = np.array([c**2 for c in contrast]).astype(np.float32)[rows.image][:, None]
    time, width = SIGMA**2 / 2, image.shape[1]
    right, down = np.zeros_like(level), np.zeros_like(level)  # nothing flows out of an image
    change, across, along = np.empty(level.size, level.dtype), np.empty(level.size - 1, level.dtype), np.empty(level.size - width, level.dtype)
    yield SIGMA, level
    for k in range(1, DIFFUSION_LEVELS):
        sigma = SIGMA * 2 ** (k / STEPS)
        span, time = sigma**2 / 2 - time, sigma**2 / 2
        n = math.ceil(math.sqrt(3 * span / 0.25 + 0.25) - 0.5)
        scale = 3 * span / (0.25 * n * (n + 1))
        gx, gy = (g / 2 for g in _gradients(blurred(level, 1.0, rows), rows))
        flow = (1 / (1 + (gx * gx + gy * gy) / squared)).astype(np.float32)
        right[:, :-1], down[:-1] = (flow[:, 1:] + flow[:, :-1]) / 2, (flow[1:] + flow[:-1]) / 2
        down[rows.last] = 0
        to_right, to_below, flat = right.ravel()[:-1], down.ravel()[:-width], level.ravel().copy()
        for j in range(n):
            tau = np.float32(scale * 0.25 / (2 * math.cos(math.pi * (2 * j + 1) / (4 * n + 2)) ** 2))
            np.subtract(flat[1:], flat[:-1], out=across)
            across *= to_right
            np.subtract(flat[width:], flat[:-width], out=along)
            along *= to_below
            change[:-1], change[-1] = across, 0
            change[1:] -= across
            change[:-width] += along
            change[width:] -= along
            change *= tau
            flat += change
        level = flat.reshape(level.shape)
        yield sigma, level


N_BITS = 3 * sum(k * k * (k * k - 1) // 2 for k in CELLS)


def detect_binary(green: np.ndarray, limit: int):
    """Positions (x, y) of the strongest `limit` keypoints of the second detector, and their descriptors as bits packed in bytes."""
    return detect_binary_of([green], limit)[0]


def detect_binary_of(greens, limit: int) -> list[tuple]:
    """`detect_binary` of each image; small ones are worked on together."""
    out = [(np.zeros((0, 2), np.float32), np.zeros((0, -(-N_BITS // 64) * 8), np.uint8))] * len(greens)
    for numbers, image, rows, factor in stacked(greens):
        for k, found in zip(numbers, _stack_binary(image, rows, factor, limit, out[numbers[0]]), strict=True):
            out[k] = found
    return out


def _stack_binary(image: np.ndarray, rows: Rows, factor: int, limit: int, none: tuple) -> list[tuple]:
    levels, responses = [], []
    for sigma, level in diffused(image, rows):
        smooth = blurred(level, max(1.0, sigma / 2), rows)
        gx, gy = _gradients(smooth, rows)
        xx, xy = _gradients(gx, rows)
        yy = _gradients(gy, rows)[1]
        levels.append((sigma, level, gx, gy))
        responses.append((xx * yy - xy * xy) / 16 * np.float32(sigma**4))
    points, largest = [], [_largest(r) for r in responses]
    for k in range(1, len(levels) - 1):
        r = responses[k]
        middle = r[1:-1, 1:-1]
        peak = (middle > HESSIAN_LEAST) & (middle >= largest[k]) & (middle > largest[k - 1]) & (middle > largest[k + 1])
        ys, xs = np.nonzero(peak & rows.inner[1:-1, None])
        ys, xs = ys + 1, xs + 1
        for dy, dx in _BEFORE:
            above = r[ys, xs] > r[ys + dy, xs + dx]
            ys, xs = ys[above], xs[above]
        points.append(np.stack([rows.image[ys], np.full(len(ys), k), rows.at[ys], xs, r[ys, xs]], 1))
    del responses, largest
    points = np.concatenate(points)
    points = points[np.lexsort((points[:, 3], points[:, 2], points[:, 1], -points[:, 4], points[:, 0]))]
    points = points[_strongest(points[:, 0], limit)]
    points = points[np.lexsort((points[:, 1], points[:, 0]))]  # of each level as they were
    if not len(points):
        return [none] * len(rows.heights)
    sampled, where = Planes(), np.zeros((len(points), 3), np.int64)
    for k in np.unique(points[:, 1]).astype(int):
        at = np.flatnonzero(points[:, 1] == k)
        where[at] = sampled.add(levels[k][1:], rows, points[at, 0].astype(np.int64))
    scale = np.array([sigma for sigma, *_ in levels])[points[:, 1].astype(int)]
    del levels
    level, gx, gy = sampled.joined()
    group = points[:, 0] * 64 + points[:, 1]
    which, angle = directed(gx, gy, where, points[:, 2], points[:, 3], scale, group)
    points, where, scale, group = points[which], where[which], scale[which], group[which]
    bits = np.zeros((len(points), -(-N_BITS // 8)), np.uint8)
    # One by itself in its level was summed up pairwise, others one after the other: as before, so that equal means stay equal.
    _, of, members = np.unique(group, return_inverse=True, return_counts=True)
    alone = members[of] == 1
    for rest, axis in ((np.flatnonzero(~alone), 0), (np.flatnonzero(alone), 1)):
        for part in _pieces(len(rest)) if len(rest) else ():
            i = rest[part]
            bits[i] = _cell_bits(level, gx, gy, where[i], points[i, 2], points[i, 3], scale[i], angle[i], axis)
    packed = np.pad(bits, ((0, 0), (0, none[1].shape[1] - bits.shape[1])))
    xy = np.stack([points[:, 3] * factor + (factor - 1) / 2, points[:, 2] * factor + (factor - 1) / 2], 1).astype(np.float32)
    ends = np.searchsorted(points[:, 0], np.arange(len(rows.heights) + 1))
    return [(xy[a:b], packed[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(1)
def _cells() -> list[tuple[np.ndarray, list[slice]]]:
    """For each grid the samples of the window cell by cell, and where each cell's are among them."""
    v, u = _window(24)
    out = []
    for n in CELLS:
        cell = np.minimum((v + 1) / 2 * n, n - 1e-9).astype(int) * n + np.minimum((u + 1) / 2 * n, n - 1e-9).astype(int)
        ends = np.searchsorted(np.sort(cell), np.arange(n * n + 1))
        out.append((np.argsort(cell, kind="stable"), [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]))
    return out


def _cell_bits(level, gx, gy, where, y, x, scale, angle, axis: int) -> np.ndarray:
    """Comparisons of cell means, packed in bytes. `axis` is that of the samples as their means are taken."""
    v, u = (np.expand_dims(w, 1 - axis) for w in _window(24))
    start, h, w, y, x, scale, angle = (np.expand_dims(c, axis) for c in (*where.T, y, x, scale, angle))
    c, s, reach = np.cos(angle), np.sin(angle), 6.0 * scale
    (i, a, b), inside = _sampled((level, gx, gy), (start, h, w), y + (s * u + c * v) * reach, x + (c * u - s * v) * reach)
    turned = [values * inside for values in (i, c * a + s * b, c * b - s * a)]
    parts = []
    for n, (order, cells) in zip(CELLS, _cells(), strict=True):
        first, second = np.triu_indices(n * n, 1)
        for values in turned:
            by_cell = values.take(order, axis)
            means = np.stack([np.ascontiguousarray(by_cell[q] if axis == 0 else by_cell[:, q]).mean(axis) for q in cells])
            parts.append(means[first] > means[second])
    return np.packbits(np.concatenate(parts), axis=0).T


def two_nearest_bits(query: np.ndarray, train: np.ndarray, rows: int = 256):
    """Index and number of differing bits of the two nearest train descriptors (packed bits), block of queries by block."""
    index = np.full((len(query), 2), -1, np.int64)
    distance = np.full((len(query), 2), np.inf)
    q, t = (np.ascontiguousarray(x).view(np.uint64) for x in (query, train))
    k = min(2, len(t))
    for s in range(0, len(q), rows):
        d = np.zeros((len(q[s : s + rows]), len(t)), np.uint16)
        for word in range(q.shape[1]):
            d += np.bitwise_count(q[s : s + rows, word][:, None] ^ t[:, word][None, :])
        for i in range(k):
            near = d.argmin(1)
            index[s : s + rows, i] = near
            distance[s : s + rows, i] = d[np.arange(len(d)), near]
            d[np.arange(len(d)), near] = np.iinfo(np.uint16).max
    return index, distance
