"""Small binary messages between tasks: sorted hashes as differences, numbers in as few bytes as they need."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_ints(x: np.ndarray) -> bytes:
    """Non-negative integers, each in the fewest bytes that hold the largest: one byte of width, then the bytes by significance."""
    x = np.ascontiguousarray(x, dtype="<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    x = x.astype(np.uint64)
    return pack_ints(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data), dtype=np.uint64)


def join_blobs(*parts: bytes) -> bytes:
    """Several byte strings in one."""
    sizes = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes()
    return sizes + b"".join(parts)


def split_blobs(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, dtype="<i8", count=1)[0])
    sizes = np.frombuffer(data, dtype="<i8", count=n, offset=8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers as Spark LONGs with the same bits."""
    return x.astype(np.uint64).view(np.int64)


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(*parts: bytes) -> bytes:
    """Several byte strings in one, compressed: bytes of one significance stand together, so their entropy shows."""
    data = join_blobs(*parts)
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unsqueeze(data: bytes) -> list[bytes]:
    return split_blobs(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))


def in_buckets(messages: DataFrame, bucket: str, n: int, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` over all messages of each bucket 0 .. n - 1, every bucket in a task of its own.

    The bucket number is the partition number, so equal buckets make equal tasks, which hashing it once more would undo.
    """

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from fn(pa.Table.from_batches(held)).to_batches()

    return messages.repartitionById(n, F.col(bucket).cast("int")).mapInArrow(run, schema)
