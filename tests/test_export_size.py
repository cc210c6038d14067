"""The export repeats most of its values: a job that only reads it again keeps it compressed."""

import gzip
from pathlib import Path

from test_projections import result_rows

from framewright.queries import inputs
from framewright.sources import sinks


def test_compressed_export_holds_the_same_rows_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 3)
    rows = result_rows(spark).coalesce(1)
    sinks.export_quality_csv(rows, f"{tmp_path}/plain")
    sinks.export_quality_csv(rows, f"{tmp_path}/packed", compression="gzip")
    plain = [line for f in Path(f"{tmp_path}/plain").glob("part-*.csv") for line in f.read_text().splitlines()]
    packed = [gzip.open(f, "rt").read().splitlines() for f in Path(f"{tmp_path}/packed").glob("part-*.csv.gz")]
    assert len(packed) == 3 and max(map(len, packed)) <= 1 + 3
    assert sorted(set(plain)) == sorted({line for f in packed for line in f}) and len(set(plain)) == 9


def test_the_export_that_is_read_back_is_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    monkeypatch.setattr(inputs, "export_input", lambda spark, sf: result_rows(spark))
    read = inputs.s12(spark, "")
    parts = [f.name for f in Path(f"{tmp_path}/export").glob("part-*")]
    assert parts and all(name.endswith(".csv.gz") for name in parts)
    assert read.count() == 8
