"""Files of an instance and its state, wherever Hadoop's file systems reach (local, HDFS, object stores)."""

from __future__ import annotations

import os
from datetime import UTC, datetime

from pyspark.sql import SparkSession


def join(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *[p.strip("/") for p in parts[1:]]])


def _utc(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, UTC).replace(tzinfo=None)


class LocalStore:
    """The local file system, for work without a session."""

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def folders(self, path: str) -> list[str]:
        return sorted(d for d in os.listdir(path) if os.path.isdir(os.path.join(path, d))) if os.path.isdir(path) else []

    def read(self, path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    def modified(self, path: str) -> datetime | None:
        """When the newest file directly in a folder was changed."""
        times = [os.path.getmtime(os.path.join(path, f)) for f in os.listdir(path)] if os.path.isdir(path) else []
        return _utc(max(times)) if times else None

    def write(self, path: str, text: str) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


class HadoopStore:
    """Any file system that the session can open by its scheme; paths without one go to the default."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        system, at = self._open(path)
        return system.exists(at)

    def folders(self, path: str) -> list[str]:
        system, at = self._open(path)
        return sorted(s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()) if system.exists(at) else []

    def read(self, path: str) -> str:
        system, at = self._open(path)
        stream = system.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def modified(self, path: str) -> datetime | None:
        system, at = self._open(path)
        times = [s.getModificationTime() / 1000 for s in system.listStatus(at) if s.isFile()] if system.exists(at) else []
        return _utc(max(times)) if times else None

    def write(self, path: str, text: str) -> None:
        system, at = self._open(path)
        stream = system.create(at, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


Store = LocalStore | HadoopStore
