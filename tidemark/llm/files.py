"""Binary files in the shared folder, by URI, through Arrow's filesystems (local, HDFS, object stores)."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable
from typing import BinaryIO

from pyarrow import fs as arrow_fs


def put(uri: str, write: Callable[[BinaryIO], None]) -> None:
    """Write a file whole or not at all: a lost or repeated task leaves no half file behind the name."""
    fs, path = arrow_fs.FileSystem.from_uri(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def open_at(uri: str):
    """A file open for reads at any offset."""
    fs, path = arrow_fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)
