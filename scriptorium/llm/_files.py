"""File access by URI for Python workers: local, HDFS and object stores through
pyarrow's file systems."""

from __future__ import annotations

import uuid


def open_fs(uri: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_whole(uri: str, chunks) -> int:
    """Write a file under a temporary name, then move it to its own: a task that
    is lost or repeated leaves no half file.  Returns its size."""
    system, path = open_fs(uri)
    folder = path.rsplit("/", 1)[0]
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.part-{uuid.uuid4().hex}"
    size = 0
    with system.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(part, path)
    return size


def open_random(uri: str):
    system, path = open_fs(uri)
    return system.open_input_file(path)
