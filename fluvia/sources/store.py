"""Files of a shared store, by ranges of bytes: what the readers of binary formats and of large documents have in common."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; a path without a scheme is a local (or mounted) one."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, size) of the file at ``path``, or of the files of that ending in the folder at ``path``, in order; names that begin with _ or . don't count."""
    store, base = opened(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    found = store.get_file_info(base)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    names = [(f.path, f.size) for f in every if f.type == fs.FileType.File and f.path.endswith(ending) and f.base_name[0] not in "_."]
    return sorted((scheme + p if scheme in ("", "file://") else path[: path.index(base)] + p, size) for p, size in names)


def read_range(path: str, start: int, size: int) -> bytes:
    store, base = opened(path)
    with store.open_input_file(base) as f:
        return f.read_at(size, start)


def read_all(path: str) -> bytes:
    store, base = opened(path)
    with store.open_input_stream(base) as f:
        return f.read()
