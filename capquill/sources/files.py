"""Files of any store that pyarrow knows (local paths, file:, hdfs:, s3: and others), for readers and writers inside tasks."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path)


def sizes(path: str, pattern: str | None = None) -> list[tuple[str, int]]:
    """(path, octets) of the file at a path, or of all files under it; hidden ones and markers are left out."""
    store, place = located(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path.rstrip("/")[: len(path.rstrip("/")) - len(place.rstrip("/"))]
    found = store.get_file_info(fs.FileSelector(place, recursive=True))
    named = [(PurePosixPath(x.path), x) for x in found if x.type == fs.FileType.File]
    kept = [x for p, x in named if p.name[0] not in "._" and (pattern is None or p.match(pattern))]
    return sorted((prefix + x.path, x.size) for x in kept)


class Reader:
    """Parts of one file."""

    def __init__(self, path: str):
        store, place = located(path)
        self.file: pa.NativeFile = store.open_input_file(place)
        self.size = self.file.size()

    def part(self, at: int, n: int) -> bytes:
        """n octets from an offset, or as many as there are."""
        return self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, in spark.checkpoint.dir, which driver and executors share."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints"  # one machine: every folder is shared
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
