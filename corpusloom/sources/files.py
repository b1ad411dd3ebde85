"""Files on the shared file system, for data sources written in Python: by URI or by absolute path."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; ``file:/a`` and ``/a`` are local, others as their URI says."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[fs.FileInfo]:
    """The files below a folder, or the one file, in the order of their paths; hidden ones are left out."""
    system, inner = opened(path)
    found = system.get_file_info(inner)
    if found.type == fs.FileType.File:
        return [found]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = (f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File)
    return sorted((f for f in below if not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
