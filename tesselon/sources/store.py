"""Files in any store that Arrow opens (local and shared folders, HDFS, object stores), by URI."""

from __future__ import annotations

import json

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; a path without scheme is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.FileSystem.from_uri(uri)) if "://" in uri else (fs.LocalFileSystem(), uri)


def files(uri: str, ending: str = "") -> list[tuple[str, int]]:
    """(uri, bytes) of the files below a folder, or of the file itself, in order of name."""
    store, path = located(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    root = uri.rstrip("/")
    return sorted((root + "/" + x.path[len(path.rstrip("/")) + 1 :], x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(ending))


def size(uri: str) -> int | None:
    """Bytes of a file; None if there is none."""
    store, path = located(uri)
    info = store.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None


def opened(uri: str):
    store, path = located(uri)
    return store.open_input_file(path)


def created(uri: str):
    """A stream to a new file, whose folder is made too."""
    store, path = located(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def move(old: str, new: str) -> None:
    store, path = located(old)
    to = located(new)[1]
    store.create_dir(to.rpartition("/")[0], recursive=True)
    store.move(path, to)


def drop(uri: str) -> None:
    store, path = located(uri)
    kind = store.get_file_info(path).type
    if kind == fs.FileType.Directory:
        store.delete_dir(path)
    elif kind == fs.FileType.File:
        store.delete_file(path)


def put_json(value, uri: str) -> None:
    """Writes a small JSON file in one step: it is there whole or not at all."""
    with created(uri + ".new") as f:
        f.write(json.dumps(value).encode())
    move(uri + ".new", uri)


def get_json(uri: str):
    with opened(uri) as f:
        return json.loads(f.read())
