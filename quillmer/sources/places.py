"""Files by path or URI, as tasks and driver open them: local or shared folders and all that pyarrow's file systems know."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs


def split(path: str) -> tuple[fs.FileSystem, str]:
    """File system and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def open_file(path: str) -> pa.NativeFile:
    system, p = split(path)
    return system.open_input_file(p)


def files_of(path: str) -> list[str]:
    """A file, or a folder's files in the order of their names; hidden ones and markers are left out."""
    system, p = split(path)
    if system.get_file_info(p).type != fs.FileType.Directory:
        return [path]
    inside = [f.path for f in system.get_file_info(fs.FileSelector(p, recursive=True)) if f.type == fs.FileType.File]
    prefix = path[: len(path) - len(p)] if path.endswith(p) else "file://"
    return [prefix + f for f in sorted(inside) if not any(x[:1] in ("_", ".") for x in f[len(p) :].split("/"))]
