"""Vector columns as whole numbers, packed so that equal vectors are equal bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scaled components are held inside plus and minus this.
MOST = float(2**62)


def floors(column: pa.ChunkedArray | pa.Array, scale: int) -> pa.Array:
    """``floor(scale * x)`` of each component of an array<double> column, as bytes.

    Null where the vector is null or has a null or non-finite component. The first byte is the width of a
    component (2, 4 or 8 bytes), the least that holds all of the vector.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    out: list = [None] * len(lengths)
    for length in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        own = values[starts[rows][:, None] + np.arange(length)]
        whole = np.isfinite(own).all(axis=1)
        rows, own = rows[whole], own[whole]
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(own * scale), -MOST, MOST).astype(np.int64)
        reach = np.abs(x).max(axis=1, initial=0)
        width = np.where(reach < 1 << 15, 2, np.where(reach < 1 << 31, 4, 8))
        for w in (2, 4, 8):
            mine = np.flatnonzero(width == w)
            body = np.empty((len(mine), 1 + w * length), np.uint8)
            body[:, 0] = w
            body[:, 1:] = np.ascontiguousarray(x[mine].astype(f"<i{w}")).view(np.uint8).reshape(len(mine), w * length)
            flat, size = body.tobytes(), 1 + w * length
            for k, row in enumerate(rows[mine].tolist()):
                out[row] = flat[k * size : (k + 1) * size]
    return pa.array(out, pa.binary())


def matrices(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vector length to the rows of that length and their integer matrix; nulls are in none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.drop_null().cast(pa.large_binary())
    if not len(column):
        return {}
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)
    width, size = data[offsets[:-1]].astype(np.int64), np.diff(offsets) - 1
    length = size // width
    out = {}
    for n in np.unique(length).tolist():
        x = np.zeros((int((length == n).sum()), n), np.int64)
        own = np.flatnonzero(length == n)
        for w in np.unique(width[own]).tolist():
            mine = width[own] == w
            body = data[offsets[:-1][own[mine]][:, None] + 1 + np.arange(w * n)]
            x[mine] = np.ascontiguousarray(body).view(f"<i{w}").reshape(len(body), n)
        out[n] = rows[own], x
    return out
