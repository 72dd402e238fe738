"""File systems by path or address."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyarrow.fs import FileSystem


def opened(path: str) -> tuple[FileSystem, str]:
    """The store of a path and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.rstrip("/"))
