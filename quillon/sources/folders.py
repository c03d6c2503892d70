"""Folders on any file system that Spark reaches: listing, marking, removing."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        spark = spark or SparkSession.active()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/") or "/"
        self._own = self._path(self.path)
        self._fs = self._own.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}") if name else self._own

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        """What is in the folder, in order; nothing if there is no such folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._own)) if self.exists() else []

    def matching(self, pattern: str) -> list[str]:
        """Paths below the folder that match a pattern with ``*``, as the file system names them."""
        return sorted(s.getPath().toString() for s in self._fs.globStatus(self._at(pattern)) or [])

    def touch(self, name: str) -> None:
        """An empty file, and the folders above it."""
        self._fs.create(self._at(name), True).close()

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def modified(self) -> float:
        return self._fs.getFileStatus(self._own).getModificationTime() / 1000
