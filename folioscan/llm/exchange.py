"""Keyed records sent between blocks of documents and shards of keys as packed columns.

A block writes its records for one shard as a single compressed blob; a shard concatenates the blobs it is
sent. Spark then moves a few large rows instead of one row a record, and memory follows the size of a block
or of a shard, whose number is set by ``spark.sql.shuffle.partitions``.

Each block may send to each shard, so the number of blobs is the product of both numbers. Blobs stay large if
blocks grow with the data: ``spark.folioscan.blockBytes`` sets their bytes of text, of which a task needs some 80
times as memory.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from folioscan.sources.staging import shared_path, staged as written

__all__ = ["block_bytes", "cuts", "dealt", "pack", "shard_count", "shard_of", "shared_path", "unpack", "written"]

#: Shards for each shuffle partition: enough to deal them evenly.
SHARDS_EACH = 4


def shard_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * SHARDS_EACH


def block_bytes(spark: SparkSession, default: int) -> int:
    """Bytes of text that a block holds."""
    return int(spark.conf.get("spark.folioscan.blockBytes", str(default)))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of any lengths and types as one blob. The first, if it is sorted 64-bit keys, is held as differences."""
    parts, head = [], []
    for k, x in enumerate(columns):
        x = np.ascontiguousarray(x)
        if k == 0 and x.dtype == np.uint64:
            x = np.diff(x, prepend=np.uint64(0))
        # Equal bytes of neighbouring numbers lie together, which compresses.
        flat = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T if len(x) else x.view(np.uint8)
        parts.append(np.ascontiguousarray(flat).tobytes())
        head.append((x.dtype.str.encode().ljust(8), len(x)))
    body = struct.pack("<i", len(head)) + b"".join(struct.pack("<8sq", *h) for h in head) + b"".join(parts)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<i", body)
    at, out = 4 + 16 * n, []
    for k in range(n):
        kind, size = struct.unpack_from("<8sq", body, 4 + 16 * k)
        dtype = np.dtype(kind.decode().strip())
        flat = np.frombuffer(body, np.uint8, size * dtype.itemsize, at)
        x = np.ascontiguousarray(flat.reshape(dtype.itemsize, size).T).reshape(-1).view(dtype) if size else np.zeros(0, dtype)
        if k == 0 and dtype == np.uint64:
            x = np.cumsum(x, dtype=np.uint64)
        out.append(x)
        at += size * dtype.itemsize
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: equal slices of the key range, so that sorted keys are sorted by shard."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted keys."""
    return np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))


def dealt(blobs: DataFrame, *order: str) -> DataFrame:
    """Rows of a shard brought together and sorted by shard, then ``order``."""
    return blobs.repartition("shard").sortWithinPartitions("shard", *order)
