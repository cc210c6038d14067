"""Bands and estimate together miss a pair at the threshold no more often than stated."""

import math

import numpy as np
import pytest

from framewright.llm import near


@pytest.mark.parametrize("percent", [80, 85])
def test_joint_probability_of_a_miss(percent):
    """Counts of equal registers that the confirmation drops, weighted by their exact probability."""
    j = percent / 100
    bands = near.bands_for(j)
    registers = bands * near.ROWS
    least = near.estimate_cut(j, bands)
    a = np.full((registers + 1, registers), 5, np.uint16)
    b = a.copy()
    for same in range(registers + 1):
        apart = registers - same
        b[same, :apart] = np.where(np.arange(apart) % 2, 4, 6)
    sizes = np.full(registers + 1, 1000.0)
    kept = near.likely(a, b, sizes, sizes, least)
    chance = [math.comb(registers, s) * j**s * (1 - j) ** (registers - s) for s in range(registers + 1)]
    by_estimate = sum(p for p, k in zip(chance, kept, strict=True) if not k)
    assert 0 < by_estimate + (1 - j**near.ROWS) ** bands <= near.MISSED
    assert by_estimate + chance[int(np.argmax(kept))] + (1 - j**near.ROWS) ** bands > near.MISSED, "no more is confirmed than needed"
    old = j - 4.5 * math.sqrt(j * (1 - j) / registers)
    dropped = sum(p for p, k in zip(chance, near.likely(a, b, sizes, sizes, old), strict=True) if not k)
    assert dropped > 50 * near.MISSED, "the cut by standard errors"
