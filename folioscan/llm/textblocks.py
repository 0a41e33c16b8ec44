"""Vectorised words of whole texts, for the operators that run in Arrow batches.

A batch of texts is cut into words with numpy over its UTF-8 bytes; every distinct word is held once
(Arrow's exact dictionary encoding), so that hashing or encoding costs one call per distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The bytes that separate words in the contracts, space and tab to carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64
_M1, _M2, _M3 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _U(33))
    x = x * _M1
    x ^= x >> _U(33)
    x = x * _M2
    x ^= x >> _U(33)
    return x


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets 0, l0, l0+l1, ... of consecutive segments, one more than there are segments."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... length-1 for every segment, one after the other."""
    at = starts_of(lengths)
    return np.arange(at[-1], dtype=np.int64) - np.repeat(at[:-1], lengths)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: empty) and the offset of each text in them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a batch of texts.

    code: of each word its place among the distinct ones. at: where each text's words begin. distinct: a
    string array. With ``fold`` the letters A to Z are lower-cased first.
    """

    def __init__(self, texts: pa.Array, fold: bool = False):
        raw, ends = utf8(texts)
        if fold:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            raw = table[raw]
        table = np.zeros(256, bool)
        table[list(SEPARATORS)] = True
        gap = table[raw]
        keep = ~gap
        # A word begins at a kept byte that follows a separator or opens a text.
        first = keep.copy()
        first[1:] &= gap[:-1]
        opens = ends[:-1][np.diff(ends) > 0]
        first[opens] = keep[opens]
        begin = np.flatnonzero(first)
        self.at = np.searchsorted(begin, ends).astype(np.int64)
        before = np.cumsum(keep)
        offsets = np.empty(len(begin) + 1, np.int64)
        offsets[:-1] = before[begin] - 1
        offsets[-1] = before[-1] if len(before) else 0
        column = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[keep])))
        coded = column.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        own = xxhash.xxh3_64_intdigest
        return np.fromiter((own(w, seed) for w in self.distinct.cast(pa.large_binary()).to_pylist()), _U, len(self.distinct))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes; one per start, over document ends too."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, _U)
    out = np.zeros(size, _U)
    for k in range(n):
        out = out * _M3 + hashes[k : k + size]
        out ^= out >> _U(29)
    return mix(out)


def inside(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the first ``size`` starts have n words left in their own document."""
    counts = np.diff(at)
    return (within(counts) + n <= np.repeat(counts, counts))[:size]


def blocks(batches: Iterator[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.Table]:
    """The batches dealt anew into tables of about ``limit`` bytes of text each; a longer text is one table."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + limit - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(total[stop - 1] - base)
            start = stop
            if size >= limit or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    """One column as a single array."""
    found = table.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
