"""Wide projections are generated in methods that the JVM compiles: one of more than 8,000 bytes is interpreted."""

import re

import pytest
from pyspark.sql import functions as F

from framewright.functions import names
from framewright.operators import reconcile as rc
from framewright.operators import report
from framewright.schemas import EXIF, QUALITY_DEFAULTS, SET_DEFAULTS

LONGEST = 8000


def longest_method(spark, df, capsys) -> int:
    """Bytes of the longest method in the code of a plan's stages."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        df.select("*").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)), default=0)


def result_rows(spark):
    """Result rows whose values are all computed, none a literal."""
    i = F.col("id")
    made = {"double": i / 7, "boolean": i % 2 == 0, "int": i.cast("int"), "bigint": i, "string": i.cast("string")}
    columns = [made[kind].alias(name) for name, kind, _ in (*QUALITY_DEFAULTS, *SET_DEFAULTS)]
    exif = F.struct(
        i.cast("string").alias("make"), i.cast("string").alias("model"), i.cast("int").alias("orientation"), (i / 10).alias("aperture"),
        F.element_at(F.array(F.lit(None).cast("double"), F.lit(0.00012), F.lit(0.00002), F.lit(0.5)), (i % 4 + 1).cast("int")).alias("shutter"),
        (i * 100.0).alias("iso"), (i * 1.5).alias("focal_length"), i.cast("string").alias("datetime"),
        F.struct((i / 3).alias("lat"), (i / 3).alias("lon")).alias("gps"),
    ).cast(EXIF)
    path = F.concat(F.lit("/a/"), i.cast("string"), F.lit(".jpg")).alias("path")
    return spark.range(8).select(
        path, *columns, exif.alias("exif"), (i == 9).alias("is_error"), F.lit("jvm").alias("load_backend"), F.lit("").alias("load_note")
    )


def test_export_rows_are_made_in_short_methods(spark, capsys):
    found = report.export_rows(result_rows(spark))
    assert longest_method(spark, found, capsys) < LONGEST
    assert [r[0] for r in found.orderBy("path").select("exif_shutter").limit(4).collect()] == ["", "0.00012", "2e-05", "0.5"]


def test_a_name_is_taken_apart_once_for_a_destination(spark, capsys):
    i = F.col("id").cast("string")
    files = spark.range(4).select(F.concat(F.lit("/a/"), i, F.lit("/x.b.jpg")).alias("path"), *[i.alias(c) for c in rc.META])
    found = rc.destination_request(files, rc.TransferPlan("/out", name_model=True)).select("stem", "suffix")
    capsys.readouterr()
    found.explain("cost")
    assert capsys.readouterr().out.split("== Physical Plan ==")[0].count("substring_index(") <= 12
    assert sorted(tuple(r) for r in found.collect()) == [(f"x.b_{n}", ".jpg") for n in range(4)]


@pytest.mark.parametrize(
    "path, stem, suffix",
    (("/a/b.c.jpg", "b.c", ".jpg"), ("/a/.hidden", ".hidden", ""), ("/a/..x.y", "..x", ".y"), ("c:\\d\\e.", "e.", ""), ("", "", ""), (None, None, "")),
)
def test_parts_of_names(spark, path, stem, suffix):
    row = spark.createDataFrame([(path,)], "path string").select(names.stem("path"), names.suffix("path")).first()
    assert tuple(row) == (stem, suffix)
