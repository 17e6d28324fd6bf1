"""Files in the shared folder, opened inside tasks."""

from __future__ import annotations


def file_system(uri: str):
    """``(file system, path)`` of a folder given by URI or by path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))
