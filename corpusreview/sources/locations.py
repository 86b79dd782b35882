"""One rule for folders and files that are given as a path or as a URI."""

from __future__ import annotations


def open_location(where: str):
    """File system and path of ``where``: a plain path, ``file:/x``, ``file:///x`` or the URI of another store."""
    from pyarrow import fs

    if where.startswith("file:"):
        where = "/" + where.removeprefix("file:").lstrip("/")
    files, path = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
    return files, path.rstrip("/") or "/"
