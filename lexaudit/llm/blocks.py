"""Packed columns in binary values: a few large rows instead of many small ones."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys: differences, by byte planes, compressed."""
    return pack_planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    """The inverse of pack_keys."""
    return np.cumsum(unpack_planes(data, np.uint64), dtype=np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    """Fixed-width values by byte planes, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return len(values).to_bytes(8, "little") + zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 3)


def unpack_planes(data: bytes, dtype: type) -> np.ndarray:
    """The inverse of pack_planes."""
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(zstandard.decompress(data[8:], max_output_size=max(1, n * np.dtype(dtype).itemsize)), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, n).T).view(dtype).ravel()


def pack_bytes(values: list[bytes]) -> bytes:
    """A list of byte strings, compressed."""
    sizes = np.array([len(x) for x in values], "<u4")
    return len(values).to_bytes(8, "little") + zstandard.compress(sizes.tobytes() + b"".join(values), 3)


def unpack_bytes(data: bytes) -> list[bytes]:
    """The inverse of pack_bytes."""
    n = int.from_bytes(data[:8], "little")
    raw = zstandard.decompress(data[8:], max_output_size=1 << 34) if n else b""
    ends = (np.cumsum(np.frombuffer(raw[: 4 * n], "<u4"), dtype=np.int64) + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends], ends, strict=False)]


def packed_ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of ids as numbers, 0 for null, and whether each is known."""
    known = np.array([x is not None for x in column.to_pylist()], bool)
    return column.cast(pa.int64()).fill_null(0).to_numpy().astype(np.int64), known


def chunks(batches: Iterable[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.Table]:
    """Whole rows in tables of about size bytes of the column, one at least."""
    held, n = [], 0
    for batch in batches:
        lengths = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
        start = 0
        for i, x in enumerate(lengths):
            n += x
            if n >= size:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held)
                held, n, start = [], 0, i + 1
        if start < len(batch):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
