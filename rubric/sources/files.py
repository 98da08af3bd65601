"""Files by path, for tasks that read or write them without a Spark reader."""

from __future__ import annotations

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there.  Hadoop's short ``file:/`` and ``s3a:`` are understood."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("s3:" + path[len("s3a:"):] if path.startswith("s3a:") else path)
