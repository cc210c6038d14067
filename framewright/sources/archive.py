"""Quality scores kept inside zipped project documents."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.names import base_name
from framewright.sources.files import list_files, open_file, spread

# File, member and property names of the project format.
ARCHIVE_NAME = "frame.zip"
DOCUMENT_SUFFIX = "doc.xml"
QUALITY_PROPERTY = "Image/Quality"

ROWS = 5000  # cameras that leave a task at once
CAMERAS = "path string, camera_id string, photo string, quality string, problem string"


class Seeking:
    """An open file as `zipfile` wants it: a place before the file is an OSError."""

    def __init__(self, stream):
        self.stream = stream
        self.tell = stream.tell

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        place = at + (0, self.stream.tell(), self.stream.size())[whence]
        if place < 0:
            raise OSError(f"no place {place}")
        self.stream.seek(place)
        return place

    def read(self, size: int | None = None) -> bytes:
        return self.stream.read(size if size is not None and size >= 0 else None)


def cameras(document) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(id, path of the photo, quality) of each camera of a document, as its element ends; none is kept."""
    stack: list = []
    for event, element in ElementTree.iterparse(document, events=("start", "end")):
        if event == "start":
            stack.append(element)
            continue
        stack.pop()
        if element.tag == "camera":
            photo = element.find("photo")
            named = (p for p in element.iterfind("meta/property") if p.get("name") == QUALITY_PROPERTY)
            quality = next(named, None)
            yield element.get("camera_id"), None if photo is None else photo.get("path"), None if quality is None else quality.get("value")
        if stack and "camera" not in (e.tag for e in stack):
            stack[-1].remove(element)  # what is done is not held until the document ends


def archive_rows(path: str) -> Iterator[tuple]:
    """Rows of CAMERAS of one archive, or one row that names the problem if it, or its document, cannot be read to the end.

    Only the directory of the archive and the one member are read, by ranges. The document is gone through twice, so
    that a damaged one gives no cameras though nothing of it is held.
    """
    try:
        with open_file(path) as stream, zipfile.ZipFile(Seeking(stream)) as archive:
            member = next((n for n in archive.namelist() if n.endswith(DOCUMENT_SUFFIX)), None)
            if member is None:
                yield path, None, None, None, f"no member {DOCUMENT_SUFFIX}"
                return
            with archive.open(member) as document:
                for _ in cameras(document):
                    pass
            with archive.open(member) as document:
                for camera in cameras(document):
                    yield path, *camera, None
    except Exception as e:  # noqa: BLE001  whatever is wrong with a file, only that file is left out, and named
        yield path, None, None, None, f"{type(e).__name__}: {e}"


def read_cameras(archives: DataFrame, path="path") -> DataFrame:
    """Paths of archives -> path, camera_id, photo, quality (texts) of every camera; `problem` in the one row of an unreadable archive."""

    def read(batches):
        names = [c.split()[0] for c in CAMERAS.split(", ")]
        for batch in batches:
            for place in batch["path"]:
                rows = archive_rows(place)
                while some := list(islice(rows, ROWS)):
                    yield pd.DataFrame(some, columns=names)

    return archives.select(F.col(path).alias("path")).mapInPandas(read, CAMERAS)


def quality_of_cameras(rows: DataFrame) -> DataFrame:
    """Cameras -> camera_id, filename, quality of those with a photo and a quality."""
    return (
        rows.filter("problem is null")
        .select(
            F.coalesce(F.nullif("camera_id", F.lit("")), F.lit("?")).alias("camera_id"),
            base_name(F.coalesce("photo", F.lit(""))).alias("filename"),
            F.col("quality").try_cast("double").alias("quality"),
        )
        .filter((F.col("filename") != "") & F.col("quality").isNotNull())
    )


def archives_below(spark: SparkSession, project_files: str) -> DataFrame:
    """Paths of all archives below a project's files folder; none is opened."""
    return spread(list_files(spark, project_files).select("path").filter(base_name("path") == ARCHIVE_NAME))


def read_quality_archive(spark: SparkSession, project_files: str) -> DataFrame:
    """All archives below a project's files folder -> quality rows, worst first."""
    return quality_of_cameras(read_cameras(archives_below(spark, project_files))).orderBy("quality", "camera_id")


def unreadable_archives(spark: SparkSession, project_files: str) -> DataFrame:
    """path and problem of every archive that gives no cameras because it cannot be read."""
    return read_cameras(archives_below(spark, project_files)).filter("problem is not null").select("path", "problem")
