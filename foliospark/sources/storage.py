"""File systems of tasks: a path as Spark lists or takes it, opened at any place."""

from __future__ import annotations

from typing import IO
from urllib.parse import quote


def storage_of(path: str):
    """(file system, place in it) of a local path or of an address whose file system pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(quote(path, safe=":/@%"))
    return fs.LocalFileSystem(), path


def opened(path: str) -> IO[bytes]:
    storage, place = storage_of(path)
    return storage.open_input_file(place)
