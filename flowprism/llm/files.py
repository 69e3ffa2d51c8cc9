"""Array files in the folder that all executors share, written once and mapped into memory where they are read."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict

import numpy as np

#: Maps that a Python worker holds open.
MOST_OPEN = 256
_OPEN: OrderedDict[str, list[np.ndarray]] = OrderedDict()


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, arrays: list[np.ndarray]) -> None:
    """Write arrays to a file under a name of its own, then give it its name in one step.

    A task that runs twice writes the same file twice, so readers never see a part of one.
    """
    head = np.zeros((len(arrays), 2), np.int64)
    head[:] = [(len(a), ord(a.dtype.kind) * 256 + a.dtype.itemsize) for a in arrays]
    parts = [np.array([len(arrays)], np.int64).tobytes(), head.tobytes()]
    for a in arrays:
        body = np.ascontiguousarray(a).tobytes()
        parts += [body, bytes(-len(body) % 8)]
    path, temporary = _local(uri), f".{uuid.uuid4().hex}"
    if path is None:
        store, path = _remote(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path + temporary) as out:
            out.write(b"".join(parts))
        store.move(path + temporary, path)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + temporary, "wb") as out:
        out.writelines(parts)
    os.replace(path + temporary, path)


def arrays(uri: str) -> list[np.ndarray]:
    """The arrays of a file, mapped; a store that cannot be mapped is read into memory. Empty where there is no file."""
    if uri in _OPEN:
        _OPEN.move_to_end(uri)
        return _OPEN[uri]
    path = _local(uri)
    if path is None:
        store, path = _remote(uri)
        there = store.get_file_info(path).type.name == "File"
        data = np.frombuffer(store.open_input_file(path).read(), np.uint8) if there else None
    else:
        data = np.memmap(path, np.uint8, "r") if os.path.exists(path) else None
    out = []
    if data is not None:
        n = int(data[:8].view(np.int64)[0])
        head, at = data[8 : 8 + 16 * n].view(np.int64).reshape(n, 2), 8 + 16 * n
        for size, kind in head.tolist():
            width = kind % 256
            out.append(np.asarray(data[at : at + size * width]).view(f"{chr(kind // 256)}{width}"))
            at += size * width + -(size * width) % 8
    _OPEN[uri] = out
    if len(_OPEN) > MOST_OPEN:
        _OPEN.popitem(last=False)
    return out
