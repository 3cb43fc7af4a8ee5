"""Arrays in the shared folder: written whole by tasks, memory-mapped by workers.

Where the folder is on a file system that all machines mount, a worker maps the file in place. In any other store that
pyarrow reads, it fetches the file into a nameless temporary file and maps that.
"""

import io
import mmap
import os
import sys
import tempfile
import uuid
from collections import OrderedDict

import numpy as np

#: Files that a worker keeps mapped.
MAPPED = 4096
#: Where a map keeps its file open (before Python 3.13), files that a worker may hold open.
_NO_FILE = {"trackfd": False} if sys.version_info >= (3, 13) else {}
if not _NO_FILE:
    MAPPED = 256
_maps: OrderedDict[str, np.ndarray] = OrderedDict()


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array under a name; a task that runs twice leaves the same file."""
    path, values = _local(f"{folder}/{name}.npy"), np.ascontiguousarray(values)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, values)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(f"{folder}/{name}.npy")
    store.create_dir(os.path.dirname(at), recursive=True)
    part, raw = f"{at}.{uuid.uuid4().hex}", io.BytesIO()
    np.save(raw, values)
    with store.open_output_stream(part) as f:
        f.write(raw.getbuffer())
    store.move(part, at)


def _map(path: str) -> np.ndarray:
    """The array in a file, mapped; the file itself isn't held open where Python can do so."""
    if os.path.getsize(path) <= 4096:
        return np.load(path)
    with open(path, "rb") as f:
        np.lib.format.read_magic(f)
        shape, _, kind = np.lib.format.read_array_header_1_0(f)
        raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_NO_FILE)
        return np.frombuffer(raw, kind, int(np.prod(shape)), f.tell()).reshape(shape)


def opened(folder: str, name: str) -> np.ndarray:
    """The array, memory-mapped anew."""
    uri = f"{folder}/{name}.npy"
    if path := _local(uri):
        return _map(path)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryDirectory() as d, store.open_input_stream(at) as f:
        with open(f"{d}/x.npy", "wb") as g:
            while block := f.read(1 << 22):
                g.write(block)
        return _map(f"{d}/x.npy")


def mapped(folder: str, name: str) -> np.ndarray:
    """The array, memory-mapped, from the worker's map of recent files."""
    uri = f"{folder}/{name}.npy"
    if uri in _maps:
        _maps.move_to_end(uri)
        return _maps[uri]
    values = _maps[uri] = opened(folder, name)
    if len(_maps) > MAPPED:
        _maps.popitem(last=False)
    return values
