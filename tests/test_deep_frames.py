"""Small deep rasters leave their task together, large ones do not wait for each other."""

import numpy as np
import pandas as pd

from framewright.queries.png import deep_png
from framewright.sources import files


def _frames(tmp_path):
    paths = []
    for k in range(20):
        paths.append(str(tmp_path / f"{k:02d}.png"))
        (tmp_path / f"{k:02d}.png").write_bytes(deep_png(np.full((8, 8, 1), k * 256, np.uint16), 0, (0, 1, 2)))
    return paths, list(files._deep_rasters([pd.DataFrame({"path": paths[:15]}), pd.DataFrame({"path": paths[15:]})]))


def test_small_rasters_leave_together(tmp_path):
    paths, found = _frames(tmp_path)
    assert len(found) == 1 and list(found[0]["path"]) == paths
    assert [d[0] for d in found[0]["data"]] == list(range(20))


def test_large_rasters_leave_one_by_one(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "HELD_BYTES", 300)
    assert [len(f) for f in _frames(tmp_path)[1]] == [1] * 20
