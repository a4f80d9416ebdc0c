"""Scans: images, archives, tables of results, device metadata, EXIF and rasters."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import IO
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import base_name, stem
from gridloom.operators.labels import normalize_device

IMAGE_PATTERN = r"(?i)\.(jpe?g|png|webp|tiff?)$"
MEMBER = "archive string, member string, size long, content binary"


def binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def whole_texts(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(text, label_path) of text files. File scans give no row for an empty file, which is a label file too, so the
    names come from the file index, which the driver holds for any scan."""
    found = binary(spark, folder, glob)
    paths = spark.createDataFrame([(unquote(p),) for p in found.inputFiles()], "label_path string")
    texts = found.select(F.col("path").alias("label_path"), F.decode("content", "UTF-8").alias("text"))
    plain = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/")  # noqa: E731  file:/x and file:///x are one
    paths, texts = (d.withColumn("label_path", plain("label_path")) for d in (paths, texts))
    return paths.join(texts, "label_path", "left").select(F.coalesce("text", F.lit("")).alias("text"), "label_path")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images below a folder with name and stem; contents are not read unless a later step selects them. A missing folder has none."""
    try:
        found = binary(spark, folder)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return found.where(F.col("path").rlike(IMAGE_PATTERN)).withColumns({"name": base_name("path"), "stem": F.lower(stem("path"))})


def safe_members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The members, none of which may leave the folder or be a link."""
    out = []
    for info in archive.infolist():
        path = PurePosixPath(info.filename)
        if path.is_absolute() or ".." in path.parts or not path.parts or (info.external_attr >> 16) & 0o170000 == 0o120000:
            raise ValueError(f"unsafe archive member: {info.filename!r}")
        out.append(info)
    return out


def _stream(path: str) -> IO[bytes]:
    """A file that can be read at any place, so an archive is never held whole."""
    if re.match(r"file:/|/", path):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    store, inner = FileSystem.from_uri(quote(path, safe=":/@?=&"))
    return store.open_input_file(inner)


def _wanted(archive: zipfile.ZipFile, excluded_roots: tuple[str, ...]) -> list[zipfile.ZipInfo]:
    return [i for i in safe_members(archive) if not i.is_dir() and PurePosixPath(i.filename).parts[0] not in excluded_roots]


def read_archives(files: DataFrame, excluded_roots: tuple[str, ...] = ()) -> DataFrame:
    """Members of the ZIP files named by ``path``; bad checksums and unsafe names fail the read.

    Archives of any size: their directories are read first, then members are dealt out to tasks, each of which reads
    its own from their places in the file. A member is a row.
    """

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _stream(path) as source, zipfile.ZipFile(source) as archive:
                    wanted = {id(info) for info in _wanted(archive, excluded_roots)}
                    places = [place for place, info in enumerate(archive.infolist()) if id(info) in wanted]
                if places:
                    yield pd.DataFrame({"archive": [path] * len(places), "place": places})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, group in batch.groupby("archive", sort=False):
                with _stream(path) as source, zipfile.ZipFile(source) as archive:
                    listed = archive.infolist()
                    for place in group["place"]:
                        yield _member(path, archive, listed[place])

    listed = files.select("path").mapInPandas(names, "archive string, place long")
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes of names are not put in one task
    return listed.repartition(tasks, "archive", "place").sortWithinPartitions("archive", "place").mapInPandas(run, MEMBER)


def _member(path: str, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> pd.DataFrame:
    return pd.DataFrame([(path, info.filename, info.file_size, archive.read(info))], columns=["archive", "member", "size", "content"])  # read() checks the CRC


def nested_archive(members: DataFrame, name: str) -> DataFrame:
    """The members of archives inside others, which are rows and so held by their task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["member"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in _wanted(archive, ()):
                        yield _member(path, archive, info)

    return members.where(F.col("member").endswith(name)).select("member", "content").mapInPandas(run, MEMBER)


def read_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as text:
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def training_results(spark: SparkSession, runs_root: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(f"{runs_root}/training/*/result.json")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.json(path)


def training_history(spark: SparkSession, path: str) -> DataFrame:
    """A history CSV with every column as text; byte order mark and blanks around names and values are dropped."""
    raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    if not raw.columns:
        raise ValueError(f"{path} is empty")
    return raw.select(*(F.trim(F.col(f"`{c}`")).alias(c.replace("﻿", "").strip()) for c in raw.columns))


def device_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, device) of a filename,device CSV, and beside it the rows that strict readers refuse: unknown or conflicting devices."""
    raw = spark.read.option("header", "true").csv(path)
    raw = raw.toDF(*(c.replace("﻿", "").strip() for c in raw.columns))
    if not {"filename", "device"} <= set(raw.columns):
        raise ValueError("device metadata needs the columns filename,device")
    rows = raw.select(F.lower(base_name("filename")).alias("name"), normalize_device("device").alias("device"))
    found = rows.groupBy("name").agg(F.min("device").alias("device"), F.count_distinct("device").alias("kinds"), F.count_if(F.col("device") == "unknown").alias("unknown"))
    bad = found.select("name", F.when(F.col("unknown") > 0, "unknown").when(F.col("kinds") > 1, "conflicting").alias("reason")).where("reason is not null")
    return found.select("name", "device"), bad


#: EXIF tags of camera make, camera model and orientation.
EXIF_TAGS = {271: "make", 272: "model", 274: "orientation"}


def parse_exif(content: bytes) -> tuple[str, str, int]:
    """(make, model, orientation) from a JPEG's APP1 segment or a TIFF; empty and 1 where there is none."""
    found: dict[str, object] = {"make": "", "model": "", "orientation": 1}
    block = None
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
            size = struct.unpack(">H", content[at + 2 : at + 4])[0]
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                block = content[at + 10 : at + 2 + size]
                break
            at += 2 + size
    elif content[:4] in (b"II*\0", b"MM\0*"):
        block = content
    if block and len(block) >= 8:
        order = "<" if block[:2] == b"II" else ">"
        try:
            start = struct.unpack(order + "I", block[4:8])[0]
            for k in range(struct.unpack(order + "H", block[start : start + 2])[0]):
                tag, kind, count, value = struct.unpack(order + "HHI4s", block[start + 2 + 12 * k : start + 14 + 12 * k])
                if tag not in EXIF_TAGS:
                    continue
                if kind == 2:
                    raw = value[:count] if count <= 4 else block[(offset := struct.unpack(order + "I", value)[0]) : offset + count]
                    found[EXIF_TAGS[tag]] = raw.split(b"\0")[0].decode("latin-1")
                elif kind == 3:
                    found[EXIF_TAGS[tag]] = struct.unpack(order + "H", value[:2])[0] or 1
        except struct.error:
            pass
    return str(found["make"]), str(found["model"]), int(found["orientation"]) if str(found["orientation"]).isdigit() else 1


def image_size(content: bytes) -> tuple[int, int]:
    """(width, height) from the header of a PNG or JPEG; zeros for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", content[16:24])
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        if content[at + 1] in (0xC0, 0xC1, 0xC2, 0xC3):
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    return 0, 0


def with_camera(images: DataFrame) -> DataFrame:
    """Adds ``exif`` (make, model, orientation), ``raw_size`` and ``canonical_size`` (as turned by the orientation)."""

    @F.pandas_udf("make string, model string, orientation int, width int, height int")
    def camera(contents: pd.Series) -> pd.DataFrame:
        rows = [(*parse_exif(c), *image_size(c)) for c in contents]
        return pd.DataFrame(rows, columns=["make", "model", "orientation", "width", "height"])

    seen = images.withColumn("_c", camera("content"))
    size = F.array("_c.width", "_c.height")
    return seen.withColumns({"exif": F.struct("_c.make", "_c.model", "_c.orientation"), "raw_size": size, "canonical_size": F.when(F.col("_c.orientation") >= 5, F.reverse(size)).otherwise(size)}).drop("_c")


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures: origin, height, width, nChannels and data in BGR(A) order."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
