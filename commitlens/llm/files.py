"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

import pyarrow.fs as pafs


def uri(path: str) -> str:
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    return "file://" + path if path.startswith("/") else path


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return pafs.FileSystem.from_uri(uri(path))


def make_folder(path: str) -> None:
    fs, at = open_fs(path)
    fs.create_dir(at, recursive=True)
