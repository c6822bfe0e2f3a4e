"""Small numpy and Arrow helpers used inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pick(offsets: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged table (flat values cut at offsets), one after the other: their lengths and their values."""
    lengths = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(offsets[rows] - (ends - lengths), lengths)
    return lengths, flat[np.arange(total, dtype=np.int64) + shift]


def offsets_of(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    return at - at[0], np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]


def binary(offsets: np.ndarray, flat: np.ndarray) -> pa.Array:
    """The reverse of `raw`: a binary column over the given bytes."""
    data = np.ascontiguousarray(flat).view(np.uint8)
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.array([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of some batches, in order, in batches whose `column` holds about `limit` bytes; a longer row is one by itself."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at, _ = raw(batch.column(column))
        first = 0
        for i in range(len(batch)):
            if size + at[i + 1] - at[first] > limit and (held or i > first):
                if i > first:
                    held.append(batch.slice(first, i - first))
                yield pa.concat_batches(held)
                held, size, first = [], 0, i
        if first < len(batch):
            held.append(batch.slice(first))
            size += int(at[-1] - at[first])
    if held:
        yield pa.concat_batches(held)


def pack_ints(values: np.ndarray, level: int = 3) -> bytes:
    """Unsigned 32-bit integers as four byte planes, compressed; small values pack well."""
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def frames(*parts: bytes) -> bytes:
    """Several byte strings in one, each behind its length."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframe(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64."""
    out = np.full(max(n, 1), _ODD, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hash_rows(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of a ragged byte table; equal rows hash alike wherever they stand."""
    lengths = np.diff(offsets)
    if not len(lengths):
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(len(flat), dtype=np.int64) - np.repeat(offsets[:-1], lengths)
    terms = mix64(flat.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max(initial=0)))[place]
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)  # sums wrap around, and so do their differences
    np.cumsum(terms, out=sums[1:])
    return mix64(sums[offsets[1:]] - sums[offsets[:-1]] + lengths.astype(np.uint64) * _ODD)
