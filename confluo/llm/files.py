"""Files in the shared folder, opened by executors through Arrow's file systems.

``file://``, ``hdfs://``, ``s3://`` and ``gs://`` work as Arrow supports them. Writers
give every attempt its own name; only names that a finished task has returned
are ever read, so a repeated or lost task leaves no trace in results.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from confluo.plans.shared import new_dir


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder, made."""
    uri = new_dir(spark, name)
    system, path = file_system(uri)
    system.create_dir(path, recursive=True)
    return uri


def attempt_name(prefix: str, suffix: str) -> str:
    context = TaskContext.get()
    return f"{prefix}-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}{suffix}"


def write(uri: str, data: bytes) -> None:
    system, path = file_system(uri)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def opened(uri: str) -> pa.NativeFile:
    """The file as a stream to read in pieces."""
    system, path = file_system(uri)
    return system.open_input_stream(path, compression=None)


def read(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        f.seek(offset)
        return f.read() if length is None else f.read(length)


def size(uri: str) -> int:
    system, path = file_system(uri)
    return system.get_file_info(path).size
