"""Binary files that tasks write to, and read from, the shared folder of the cluster."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from quarry.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared folder that spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write(uri: str, parts: list[bytes]) -> None:
    """Write a whole file; other attempts of the same task write the same bytes, and the last to finish stays."""
    files, path = _place(uri)
    folder, name = path.rsplit("/", 1)
    files.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{os.getpid()}-{uuid.uuid4().hex[:8]}"
    with files.open_output_stream(part) as f:
        for p in parts:
            f.write(p)
    files.move(part, path)


def read(uri: str, start: int = 0, length: int | None = None) -> bytes:
    """Bytes [start, start + length) of a file; as many as there are."""
    files, path = _place(uri)
    with files.open_input_file(path) as f:
        size = f.size()
        start = min(start, size)
        return f.read_at(min(size - start, size if length is None else length), start)
