"""Snapshots of repositories: files of a folder or of zip archives, decoded, and their trees."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """path (below the folder), content of the files that are UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", "^.*?" + path.split(":", 1)[-1].strip("/").replace(".", r"\.") + "/", "")
    return raw.select(name.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")).filter("content is not null")


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """archive, path (without the archive's root folder), content of the files that are UTF-8; broken archives have none."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    files = zipfile.ZipFile(io.BytesIO(content.as_py()))
                except zipfile.BadZipFile:
                    continue
                with files:
                    rows, size = [], 0
                    for entry in files.infolist():
                        inner = entry.filename.partition("/")[2]
                        if not inner or entry.is_dir():
                            continue
                        try:
                            rows.append((archive, inner, files.read(entry).decode()))
                        except (UnicodeDecodeError, zipfile.BadZipFile, zlib.error):
                            continue
                        size += entry.file_size
                        if size > 4 << 20:
                            yield out(rows)
                            rows, size = [], 0
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["archive", "path", "content"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(F.col("path").alias("archive"), "content")
    return raw.mapInArrow(unpack, "archive string, path string, content string")


def tree_of(files: DataFrame) -> DataFrame:
    """path, type, blob_sha (as git hashes blobs), size."""
    body = F.col("content").cast("binary")
    header = F.concat(F.lit("blob "), F.octet_length("content").cast("string"))
    return files.select("path", F.lit("blob").alias("type"), F.sha1(F.concat(header.cast("binary"), F.lit(b"\0"), body)).alias("blob_sha"), F.octet_length("content").cast("long").alias("size"))
