"""Plain files in the shared folder, written and read by tasks through any file system."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write_bytes(folder: str, name: str, chunks) -> str:
    """A file of its own for this attempt of the task; its URI."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    uri = f"{folder}/{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/{uri.rsplit('/', 1)[1]}") as out:
        for chunk in chunks:
            out.write(chunk)
    return uri


def read_range(uri: str, start: int, size: int) -> bytes:
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        return f.read_at(max(0, min(size, f.size() - start)), start)


def mapped(uri: str, dtype) -> np.ndarray:
    """The file as an array, memory-mapped: in place where it is local, else from a copy that goes away with the mapping."""
    if uri.startswith("file:"):
        path, own = uri.split("file://", 1)[1] if "://" in uri else uri[5:], False
    else:
        system, source = _open(uri)
        handle, path = tempfile.mkstemp()
        own = True
        with system.open_input_stream(source) as f, os.fdopen(handle, "wb") as out:
            while chunk := f.read(8 << 20):
                out.write(chunk)
    try:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    finally:
        if own:
            os.unlink(path)
