"""Statistics of a pixel histogram and colour expressions.

A histogram arrives as its cumulative counts: 256 numbers, entry v = how many pixels are <= v.
That is enough for exact means, deviations, shares and interpolated percentiles without any pixel.
Histogram functions take a column name and return one SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percentile(cumulative: str, q: float) -> Column:
    """Linear-interpolated percentile, the definition of Spark's exact `percentile`."""
    position = f"((element_at({cumulative}, -1) - 1) * {q}D)"
    low = f"size(filter({cumulative}, _n -> _n <= floor({position})))"
    high = f"size(filter({cumulative}, _n -> _n <= ceil({position})))"
    return F.expr(f"{low} + ({high} - {low}) * ({position} - floor({position}))")


def mean(cumulative: str) -> Column:
    c = cumulative
    return F.expr(f"aggregate({c}, 0L, (_sum, _n) -> _sum + element_at({c}, -1) - _n) / element_at({c}, -1)")


def deviation(cumulative: str) -> Column:
    c = cumulative
    squares = f"""aggregate(transform({c}, (_n, _v) -> (element_at({c}, -1) - _n) * (2 * _v + 1)), 0L, (_sum, _n) -> _sum + _n)
        / element_at({c}, -1)"""
    average = f"aggregate({c}, 0L, (_sum, _n) -> _sum + element_at({c}, -1) - _n) / element_at({c}, -1)"
    return F.expr(f"sqrt(greatest(0D, {squares} - power({average}, 2)))")


def share_at_most(cumulative: str, level: int) -> Column:
    return F.expr(f"element_at({cumulative}, {level + 1}) / element_at({cumulative}, -1)")


def share_at_least(cumulative: str, level: int) -> Column:
    return 1 - share_at_most(cumulative, level - 1) if level > 0 else F.lit(1.0)


def variance(total, total_of_squares, n) -> Column:
    m = _col(total) / _col(n)
    return F.greatest(F.lit(0.0), _col(total_of_squares) / _col(n) - m * m)


def smaller_over_larger(a, b, when_flat=1.0, floor=1e-6) -> Column:
    large = F.greatest(_col(a), _col(b))
    return F.when(large > floor, F.least(_col(a), _col(b)) / large).otherwise(F.lit(when_flat))


def white_gains(red_p95, green_p95, blue_p95) -> tuple[Column, Column]:
    g = _col(green_p95)
    return (
        F.when(g > 1e-6, _col(red_p95) / g).otherwise(1.0),
        F.when(g > 1e-6, _col(blue_p95) / g).otherwise(1.0),
    )


# sRGB transfer curve, linear RGB to XYZ, McCamy's cubic and its pivot.
SRGB_KNEE, SRGB_SLOPE, SRGB_OFFSET, SRGB_POWER = 0.04045, 12.92, 0.055, 2.4
XYZ_ROWS = (
    (0.4124, 0.3576, 0.1805),
    (0.2126, 0.7152, 0.0722),
    (0.0193, 0.1192, 0.9505),
)
MCCAMY = (449.0, 3522.0, 10226.0, 6550.0)
MCCAMY_PIVOT = (0.3320, 0.1858)
NEUTRAL_KELVIN, KELVIN_MIN, KELVIN_MAX = 6500.0, 1500.0, 11000.0


def _linear(channel) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(channel) / 255.0))
    return F.when(c <= SRGB_KNEE, c / SRGB_SLOPE).otherwise(
        F.pow((c + SRGB_OFFSET) / (1 + SRGB_OFFSET), F.lit(SRGB_POWER))
    )


def kelvin(red, green, blue) -> Column:
    """Correlated colour temperature of a white point (McCamy 1992)."""
    rgb = [_linear(c) for c in (red, green, blue)]
    x_, y_, z_ = (row[0] * rgb[0] + row[1] * rgb[1] + row[2] * rgb[2] for row in XYZ_ROWS)
    s = x_ + y_ + z_
    lit = F.when(s > 1e-9, s)
    n = (x_ / lit - MCCAMY_PIVOT[0]) / (MCCAMY_PIVOT[1] - y_ / lit)
    k = ((MCCAMY[0] * n - MCCAMY[1]) * n + MCCAMY[2]) * n + MCCAMY[3]
    return F.coalesce(F.greatest(F.lit(KELVIN_MIN), F.least(F.lit(KELVIN_MAX), k)), F.lit(NEUTRAL_KELVIN))
