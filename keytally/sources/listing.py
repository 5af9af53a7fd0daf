"""Names, times and lengths of files, empty ones among them, once or as a stream.

Spark's own file sources leave out empty files, and their streams report a path
only once. Here the driver lists the top folder alone; the folders below are
listed by the tasks.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import UTC, datetime
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

LISTED = "path string, modificationTime timestamp, length bigint"


def store_of(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The store of a path, the path in it, and what its own paths have to be preceded by to be Spark's."""
    if path.startswith("/") or path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    scheme, _, rest = path.partition("://")
    host, _, inside = rest.partition("/")
    store, _ = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
    # Object stores keep the bucket in their paths.
    return (store, f"/{inside}", f"{scheme}://{host}") if scheme == "hdfs" else (store, rest, f"{scheme}://")


def _visible(name: str) -> bool:
    return not name.startswith(("_", "."))


def _below(root: str, glob: str, recursive: bool) -> Iterator[tuple[str, pafs.FileInfo]]:
    store, inside, prefix = store_of(root)
    start = len(inside.rstrip("/")) + 1
    for info in store.get_file_info(pafs.FileSelector(inside, allow_not_found=True, recursive=recursive)):
        names = info.path[start:].split("/")
        if all(map(_visible, names)) and (not info.is_file or fnmatchcase(names[-1], glob)):
            yield prefix + info.path, info


def _time(info: pafs.FileInfo) -> datetime:
    return datetime.fromtimestamp((info.mtime_ns or 0) // 1_000_000 / 1000, UTC)


def _row(path: str, info: pafs.FileInfo) -> tuple[str, datetime, int]:
    return path, _time(info), info.size


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, modificationTime, length)`` of the files below ``root`` whose name matches ``glob``.

    Files and folders that begin with ``_`` or ``.`` are left out; a missing
    folder has no files.
    """
    top = list(_below(root, glob, recursive=False))
    files = spark.createDataFrame([_row(*found) for found in top if found[1].is_file], LISTED)
    folders = [(path,) for path, info in top if not info.is_file]
    if not folders:
        return files

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64()]
        for batch in batches:
            for folder in batch["folder"].to_pylist():
                rows = [_row(path, info) for path, info in _below(folder, glob, recursive=True) if info.is_file]
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "modificationTime", "length"])

    number = min(len(folders), int(spark.conf.get("spark.sql.shuffle.partitions")))
    deep = spark.createDataFrame(folders, "folder string").repartition(number, "folder")
    return files.unionByName(deep.mapInArrow(each, LISTED))


class _Part(InputPartition):
    def __init__(self, folder: str, recursive: bool):
        self.folder, self.recursive = folder, recursive


class _ListingReader(DataSourceStreamReader):
    def __init__(self, root: str, glob: str):
        self.root, self.glob = root, glob

    def initialOffset(self) -> dict:
        return {"listed_at": 0}

    def latestOffset(self) -> dict:
        return {"listed_at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        folders = [path for path, info in _below(self.root, self.glob, recursive=False) if not info.is_file]
        return [_Part(self.root, False), *[_Part(folder, True) for folder in folders]]

    def read(self, part: _Part) -> Iterator[tuple]:
        for path, info in _below(part.folder, self.glob, part.recursive):
            if info.is_file:
                yield _row(path, info)

    def commit(self, end: dict) -> None:
        pass


class FileListing(DataSource):
    """``readStream.format("file_listing")``: in each micro-batch all files that are there, by options ``path`` and ``glob``."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _ListingReader(self.options["path"], self.options.get("glob", "*"))


def listing_stream(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every file below ``root``, again in each micro-batch."""
    spark.dataSource.register(FileListing)
    return spark.readStream.format("file_listing").option("path", root).option("glob", glob).load()
