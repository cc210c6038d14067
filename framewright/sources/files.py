"""File catalogs, rasters and fingerprints."""

from __future__ import annotations

import hashlib
import io
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.decode import decode_raster
from framewright.functions.names import IMAGE_EXTENSIONS, has_extension
from framewright.sources.tags import Ranges, header_tags
from framewright.sources.walk import is_known, walk

# Notes of rows that cannot be measured, or not as they are.
NOTE_UNDECODABLE = "image could not be decoded"
NOTE_DEPTH = "more than 8 bits per channel: reduced to 8"

HEAD_BYTES = 1 << 18  # first read of a file, in which most have their tags; other places are sought
READ_BYTES = 1 << 22  # read at once when a file is hashed
HELD_BYTES = 1 << 22  # of decoded rasters that leave a task together

IMAGE_COLUMNS = ("path", "height", "width", "n_channels", "data")


def normal_path(path) -> Column:
    """`file:///a`, `file:/a` and `/a` name the same file; other schemes stay."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(c, "^file:/+", "/")


def catalog_from_listing(listing: DataFrame, extensions=IMAGE_EXTENSIONS, path="path", resolved: str | None = None) -> DataFrame:
    """Listing rows with a wanted extension (any case), one row per path without case (the lowest).

    `resolved` names the column of paths without links by which files are the same; without it the path itself counts.
    """
    others = [c for c in listing.columns if c != path]
    return (
        listing.filter(has_extension(path, extensions))
        .groupBy(F.lower(resolved or path).alias("__key"))
        .agg(F.min_by(F.struct(path, *others), F.col(path)).alias("__row"))
        .select("__row.*")
        .select(*listing.columns)
    )


def read_files(spark: SparkSession, paths, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """`binaryFile` rows; `content` is read only if a later step uses it. `glob` selects names in the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths).withColumn("path", normal_path("path"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length as `read_files` lists them (no hidden and no empty files), but listed by tasks.

    Patterns and file systems that only Spark knows are left to Spark's reader, which lists on the driver.
    """
    if not is_known(root):
        return read_files(spark, root).select("path", "modificationTime", "length")
    base = normal_path(F.lit(root.rstrip("/")))
    below = F.substr(normal_path("path"), F.length(base) + 1)
    hidden = below.rlike(r"/([.]|_[^/=]*(/|$))|[.]_COPYING_$")
    found = walk(spark, root).filter(~hidden & (F.col("length") > 0))
    return found.select(normal_path("path").alias("path"), "modificationTime", "length")


def spread(files: DataFrame) -> DataFrame:
    """Paths dealt out over several tasks a core: to open a file costs far more than its row tells."""
    return files.repartition(2 * files.sparkSession.sparkContext.defaultParallelism, *files.columns)


class LocalFile(io.FileIO):
    """A local file without what Arrow sets up for each file, which costs more than to read a small one."""

    def size(self) -> int:
        return os.fstat(self.fileno()).st_size


def open_file(path: str):
    """The file of a path or URI, from any file system that Arrow knows."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def open_small(path: str):
    """`open_file` for very many files, of which most are small."""
    return open_file(path) if ":/" in path else LocalFile(path)


def file_head(path: str) -> tuple[bytes, dict[str, str]]:
    """The first bytes of a file and its tags, none if it cannot be opened."""
    try:
        with open_small(path) as stream:
            head = stream.read(HEAD_BYTES)
            return head, header_tags(Ranges(stream, head))
    except OSError:
        return b"", {}


def _probe(path: str, names: tuple[str, ...]) -> tuple:
    digests = [hashlib.new(n) for n in names]
    try:
        with open_small(path) as stream:
            head = block = stream.read(READ_BYTES if names else HEAD_BYTES)
            while names and block:
                for d in digests:
                    d.update(block)
                block = stream.read(READ_BYTES)
            found = header_tags(Ranges(stream, head))
    except OSError:
        return (path, *[None for _ in names], None)
    return (path, *[d.hexdigest() for d in digests], found)


def probe_files(listing: DataFrame, names: tuple[str, ...] = ("md5", "sha256"), path="path") -> DataFrame:
    """Paths -> path, the named digests and `tags` (name to text), from one pass over each file.

    Tags are followed to wherever they stand in a file. Without digests only the parts that hold them are read.

    A task opens its files by path and reads them in blocks, so no file needs to fit anywhere, and files that are
    not in `listing` are not opened. A file that cannot be opened has NULLs.
    """

    def probe(batches):
        for batch in batches:
            for start in range(0, len(batch), 64):
                rows = [_probe(p, names) for p in batch["path"].iloc[start : start + 64]]
                yield pd.DataFrame(rows, columns=["path", *names, "tags"])

    schema = ", ".join(["path string", *[f"{n} string" for n in names], "tags map<string,string>"])
    return spread(listing.select(F.col(path).alias("path"))).mapInPandas(probe, schema)


def _sha256(paths: pd.Series) -> pd.Series:
    return pd.Series([_probe(p, ("sha256",))[1] for p in paths], dtype=object)


def with_sha256(listing: DataFrame, path="path") -> DataFrame:
    """The rows with the digest of their file, NULL if it cannot be opened. Files are opened where the rows are (see `spread`)."""
    return listing.withColumn("sha256", F.pandas_udf(_sha256, "string")(path))


def file_hashes(stale: DataFrame) -> DataFrame:
    """path, sha256 of the given files only (see `reconcile.incremental_hash`)."""
    return probe_files(stale, ("sha256",)).drop("tags")


def scan_media(spark: SparkSession, paths, recursive: bool = True, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """Files and folders -> catalog (path, modificationTime, length), one row per file however many links lead to it.

    Folders are listed by tasks, level by level (see `walk`); patterns and file systems that only Spark knows by Spark's reader.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    if not all(map(is_known, roots)):
        return catalog_from_listing(read_files(spark, roots, recursive).select("path", "modificationTime", "length"), extensions)
    found = catalog_from_listing(walk(spark, roots, recursive), extensions, resolved="resolved")
    return found.select("path", "modificationTime", "length")


def _is_deep(head: bytes, found: dict[str, str]) -> bool:
    """Whether a file has more than 8 bits a channel, of which the image source would keep the low ones."""
    if head[:4] == b"\x89PNG":
        return head[24:25] == b"\x10"
    return head[:2] in (b"II", b"MM") and any(b.isdigit() and int(b) > 8 for b in found.get("bits", "").split())


def _turn(found: dict[str, str]) -> int | None:
    turn = found.get("orientation", "")
    return int(turn) if turn.isdigit() and int(turn) else None


def _header_facts(paths: pd.Series) -> pd.DataFrame:
    """Whether a file is deep, and its orientation tag."""
    rows = [(_is_deep(head, found), _turn(found)) for head, found in map(file_head, paths)]
    return pd.DataFrame(rows, columns=["deep", "turn"]).astype({"turn": "Int32"})


RASTER_ROWS = "path string, height int, width int, n_channels int, data binary, is_error boolean, load_note string, turn_tag int"


def _deep_rasters(batches):
    """Deep files among the given paths; rasters leave the task before they come to HELD_BYTES."""
    names = ["path", *IMAGE_COLUMNS[1:], "is_error", "load_note", "turn_tag"]
    held, size = [], 0
    for row in _deep_rows(batches):
        raster = len(row[4] or b"")
        if held and size + raster > HELD_BYTES:
            yield pd.DataFrame(held, columns=names).astype({"turn_tag": "Int32"})
            held, size = [], 0
        held.append(row)
        size += raster + 256
    if held:
        yield pd.DataFrame(held, columns=names).astype({"turn_tag": "Int32"})


def _deep_rows(batches):
    for batch in batches:
        for path in batch["path"]:
            try:
                with open_file(path) as stream:
                    head = stream.read(HEAD_BYTES)
                    file = Ranges(stream, head)
                    found = header_tags(file)
                    if not _is_deep(head, found):
                        continue
                    image = decode_raster(file)
            except OSError:
                continue
            if image is None:
                yield path, -1, -1, -1, None, True, NOTE_UNDECODABLE, _turn(found)
            else:
                yield path, *image.shape, image.tobytes(), False, NOTE_DEPTH, _turn(found)


def load_rasters(spark: SparkSession, paths, recursive: bool = True) -> DataFrame:
    """Files -> path, height, width, n_channels, data (BGR), is_error, load_note, turn_tag; never fails on a file.

    Files of more than 8 bits a channel (PNG, TIFF) are decoded here, as the image source keeps only their low byte, and
    reduced to their high byte (16 bits) or stretched from their range (32 bits and floating point). Depth and
    orientation come from the tags of the file in the task that decodes it; nothing is joined or shuffled.
    """
    images = (
        spark.read.format("image")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(paths)
        .select("image.*")
        .select(normal_path("origin").alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), "data")
        .withColumn("__facts", F.pandas_udf(_header_facts, "deep boolean, turn int")("path"))
    )
    bad = F.col("height") < 0
    shallow = images.filter(~F.col("__facts.deep")).select(
        "path",
        *[F.when(~bad, F.col(c)).otherwise(F.lit(-1)).alias(c) for c in ("height", "width", "n_channels")],
        F.when(~bad, F.col("data")).alias("data"),
        bad.alias("is_error"),
        F.when(bad, NOTE_UNDECODABLE).otherwise("").alias("load_note"),
        F.col("__facts.turn").alias("turn_tag"),
    )
    return shallow.unionByName(read_files(spark, paths, recursive).select("path").mapInPandas(_deep_rasters, RASTER_ROWS))


def content_fingerprint(files: DataFrame, content="content") -> DataFrame:
    return files.withColumns({"md5": F.md5(content), "sha256": F.sha2(content, 256)}).drop(content)


def land_files(files: DataFrame, root: str, name="name", content="content") -> DataFrame:
    """Write one file per row below `root` (any file system URI) and return path and length.

    A repeated task writes the same bytes to the same name.
    """

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)
        last = None
        for batch in batches:
            for row_name, body in zip(batch[name], batch[content]):
                target = f"{base}/{row_name}"
                folder = target.rsplit("/", 1)[0]
                if folder != last:
                    system.create_dir(folder, recursive=True)
                    last = folder
                with system.open_output_stream(target) as out:
                    out.write(body)
            yield pd.DataFrame({"path": root + "/" + batch[name], "length": batch[content].map(len)})

    return files.select(name, content).mapInPandas(write, "path string, length bigint")
