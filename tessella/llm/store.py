"""Arrays in the shared folder, memory-mapped where that is a local path."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Mapping
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def _put(uri: str, write) -> None:
    """Written under another name and moved, so that a repeated task leaves a whole file."""
    path = _local(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            write(f)
        os.replace(part, path)
        return
    import pyarrow.fs as fs

    system, where = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(where), recursive=True)
    part = f"{where}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        write(f)
    system.move(part, where)


def _mapped(uri: str, of) -> np.ndarray:
    """What ``of`` maps of a local file of these bytes."""
    path = _local(uri)
    if path:
        return of(path)
    import pyarrow.fs as fs

    system, where = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(where) as source, tempfile.NamedTemporaryFile() as f:  # the mapping outlives the name
        while part := source.read(1 << 22):
            f.write(part)
        f.flush()
        return of(f.name)


def save(uri: str, array: np.ndarray) -> None:
    _put(uri, lambda f: np.save(f, np.ascontiguousarray(array)))


def load(uri: str) -> np.ndarray:
    # a plain view of the mapping: each look at a memmap object costs more than the look
    return _mapped(uri, lambda path: np.load(path, mmap_mode="r").view(np.ndarray) if os.path.getsize(path) > 128 else np.load(path))


class Spool:
    """An array that grows in a temporary file, which goes with it."""

    def __init__(self, dtype):
        self.file, self.dtype, self.n = tempfile.TemporaryFile(), np.dtype(dtype), 0

    def add(self, array: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(array, dtype=self.dtype).tobytes())
        self.n += len(array)

    def array(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, dtype=self.dtype, mode="r").view(np.ndarray) if self.n else np.zeros(0, self.dtype)


def save_all(uri: str, arrays: Mapping[str, np.ndarray]) -> None:
    """Arrays by name in one file, which is one mapping to read."""
    names, at = {}, 0
    for name, a in arrays.items():
        names[name] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(names).encode()
    head = len(head).to_bytes(8, "little") + head

    def write(f) -> None:
        f.write(head + bytes(-len(head) % 64))
        for a in arrays.values():
            for k in range(0, len(a), 1 << 20):
                f.write(a[k : k + (1 << 20)].tobytes())
            f.write(bytes(-a.nbytes % 64))

    _put(uri, write)


def load_all(uri: str) -> dict[str, np.ndarray]:
    data = _mapped(uri, lambda path: np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray))
    size = 8 + int.from_bytes(data[:8].tobytes(), "little")
    first = -(-size // 64) * 64
    return {name: data[first + at : first + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in json.loads(data[8:size].tobytes()).items()}


def remove(uri: str) -> None:
    path = _local(uri)
    if path:
        import shutil

        shutil.rmtree(path, ignore_errors=True)
        return
    import pyarrow.fs as fs

    system, where = fs.FileSystem.from_uri(uri)
    system.delete_dir(where)
