"""Snapshots kept as immutable, key-ordered versions in a shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotVersions:
    """Versions below ``<root>/<name>``; a version is written once and never replaced.

    Each attempt to write one has a folder of its own in ``data``. What makes an
    attempt the version is a small file in ``committed``, named by the version
    and moved into place when all is written. Readers go by these files, so they
    see whole versions only, and a write that failed can simply be repeated.
    Where a move replaces nothing (HDFS) the second of two writers at once fails;
    elsewhere one of them wins, and readers still see either whole.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _at(self, path: str):
        """Spark's own handle on a path and on the store that it is in."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marker(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/committed/{version}"

    def _commit(self, name: str, version: int, attempt: str) -> None:
        aside, store = self._at(f"{self.root}/{name}/data/{attempt}.commit")
        out = store.create(aside, True)
        out.write(attempt.encode())
        out.close()
        marker, _ = self._at(self._marker(name, version))
        store.mkdirs(marker.getParent())
        if store.exists(marker) or not store.rename(aside, marker):
            store.delete(aside, False)
            raise FileExistsError(f"version {version} of {name} is there already")

    def _attempt(self, name: str, version: int) -> str:
        marker, store = self._at(self._marker(name, version))
        if not store.exists(marker):
            raise FileNotFoundError(f"there is no version {version} of {name}")
        source = store.open(marker)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def versions(self, name: str) -> list[int]:
        """The committed versions in order."""
        folder, store = self._at(f"{self.root}/{name}/committed")
        found = store.listStatus(folder) if store.exists(folder) else []
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def path(self, name: str, version: int) -> str:
        """The folder that holds the files of a committed version."""
        return f"{self.root}/{name}/data/{self._attempt(name, version)}"

    def write(self, snapshot: DataFrame, name: str, version: int, key: str = "key") -> DataFrame:
        """Write the entries in key order and return the stored version.

        Ranges of keys go to one file each, sorted inside. An edit is a new
        version, so the one before it stays as the backup.
        """
        marker, store = self._at(self._marker(name, version))
        if store.exists(marker):
            raise FileExistsError(f"version {version} of {name} is there already")
        attempt = f"{version}-{uuid.uuid4().hex}"
        snapshot.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{self.root}/{name}/data/{attempt}")
        self._commit(name, version, attempt)
        return self.read(name, version)

    def read(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(self.path(name, version))

    def read_all(self, name: str) -> DataFrame:
        """All committed versions in one scan, told apart by the column ``version``."""
        paths = [self.path(name, version) for version in self.versions(name)]
        if not paths:
            raise FileNotFoundError(f"there is no version of {name}")
        number = F.regexp_extract("_metadata.file_path", "/data/([0-9]+)-[0-9a-f]{32}/[^/]*$", 1).cast("int")
        return self.spark.read.parquet(*paths).withColumn("version", number)

    def abandoned(self, name: str) -> list[str]:
        """Folders of attempts that no version is made of: failed ones, and those still being written."""
        folder, store = self._at(f"{self.root}/{name}/data")
        found = [f.getPath() for f in (store.listStatus(folder) if store.exists(folder) else []) if f.isDirectory()]
        kept = {self._attempt(name, version) for version in self.versions(name)}
        return sorted(p.toString() for p in found if p.getName() not in kept)
