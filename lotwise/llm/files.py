"""Binary files in the shared folder, written by tasks."""

from __future__ import annotations

import uuid

from pyarrow import NativeFile, fs


def publish(folder: str, name: str, data: bytes) -> str:
    """Write a whole file under a name of its own and move it into place, so that a repeated task only replaces it."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{path}/{name}")
    return f"{folder}/{name}"


def opened(uri: str) -> NativeFile:
    """A file to be read by ranges, with read_at(size, offset)."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
