"""Substring deduplication by seed and extend over winnowed anchors.

Every window of ``window`` words holds ``window - k + 1`` k-grams of words; the one with the smallest hash is
its anchor. Equal windows have equal anchors at equal offsets, so only places that share an anchor need to be
compared. Each anchor is sent to a shard of its hash together with a hash of every window that it anchors,
that is, of its extensions by up to ``window - k`` words to either side. Matches of neighbouring windows join
to maximal repeats, and the words under them are removed.

A block of documents settles its own repeats first and sends each window once, so that a passage found in a
third of all documents reaches its shard once a block and not once a document.

Defined cases: null text has no words; a null ``doc_id`` counts as smaller than any other; rows with one
``doc_id``, or without one, are told apart by a hash of their texts, which is also their order; rows with one
``doc_id`` and one text count as one place, none of them earlier than the other, and share a result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.exchange import block_bytes, cuts, dealt, pack, shard_count, unpack
from folioscan.llm.textblocks import Words, blocks, column, grams, inside, mix, starts_of, within

NO_ID = -(2**63)
#: Bytes of text that a task holds as one block.
BLOCK_BYTES = 6 << 20
#: Kept bits of a window's hash. It is compared among windows of one 64-bit anchor hash only.
WINDOW_BITS = 48


def anchors(gram: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` k-grams the place of its smallest hash, the leftmost if several."""
    size = len(gram) - span + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    best, place = gram[:size].copy(), np.arange(size)
    for k in range(1, span):
        other = gram[k : k + size]
        less = other < best
        np.copyto(best, other, where=less)
        place[less] = np.flatnonzero(less) + k
    return place


def runs(doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows merged to spans (doc, first word, end) where they touch or overlap."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + window)
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1 if len(doc) else np.zeros(0, np.int64)
    return doc[new], start[new], start[last] + window


def _places(ids: np.ndarray, sha: np.ndarray) -> np.ndarray:
    """Of sorted rows the first one with the same id and text."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (sha[1:] != sha[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))


def _send(window: int, k: int, shards: int, limit: int):
    span = window - k + 1

    def block(table: pa.Table) -> pa.RecordBatch:
        ids = column(table, "doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        sha = column(table, "text_sha").to_numpy(zero_copy_only=False)
        order = np.lexsort((sha, ids))
        ids, sha = ids[order], sha[order]
        # Rows with one id and one text are one place.
        place_of = _places(ids, sha)
        words = Words(column(table, "text").take(pa.array(order)))
        own, again = words.hashes(1)[words.code], words.hashes(2)[words.code]
        gram = grams(own, k)
        start = np.flatnonzero(inside(words.at, window, max(0, len(own) - window + 1)))
        anchor = anchors(gram, span)[start] if len(start) else start
        full = grams(again, window)[start]
        doc = np.repeat(np.arange(len(ids)), words.counts)[start]
        # The block's first window of its kind is sent; the others are repeats whatever other blocks hold.
        by = np.argsort(full, kind="stable")
        again, seed = full[by], gram[anchor[by]]
        same = np.zeros(len(by), bool)
        same[1:] = (again[1:] == again[:-1]) & (seed[1:] == seed[:-1])
        rest = same.copy()
        if len(by):  # rows of one place have the same windows
            at = start - words.at[doc]
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
            rest &= (place_of[doc[by]] != place_of[doc[by[head]]]) | (at[by] != at[by[head]])
        sent = np.ones(len(by), bool)
        sent[by] = ~same
        repeated = by[rest]
        shard, blob = [], []
        row, first, end = runs(place_of[doc[repeated]], start[repeated] - words.at[doc[repeated]], window)
        if len(row):
            shard.append(int(abs(hash(int(ids[0]))) % shards))
            blob.append(pack([np.array([1], np.int8), ids[row], sha[row], first, end]))
        kept = np.flatnonzero(sent)
        if len(kept):
            place, first, size = np.unique(anchor[kept], return_index=True, return_counts=True)
            key = mix(gram[place])  # anchors are small hashes, and shards are slices of all
            by = np.argsort(key, kind="stable")
            own_doc = doc[kept[first]]
            # A window may be missing from an anchor's run, so each is sent with its offset.
            offset = (place[np.repeat(np.arange(len(place)), size)] - start[kept]).astype(np.uint8)
            at = starts_of(size)
            row = np.repeat(at[:-1][by], size[by]) + within(size[by])
            tail = (full[kept] >> np.uint64(64 - WINDOW_BITS))[row]
            offset = offset[row]
            key, own_doc, size, pos = key[by], own_doc[by], size[by], (place - words.at[doc[kept[first]]])[by]
            edge, at = cuts(key, shards), starts_of(size)
            for s in np.flatnonzero(np.diff(edge)):
                a, b = edge[s], edge[s + 1]
                x, y = at[a], at[b]
                low = tail[x:y]
                blob.append(pack([key[a:b], ids[own_doc[a:b]], sha[own_doc[a:b]], pos[a:b].astype(np.int32), size[a:b].astype(np.uint16), offset[x:y], (low & np.uint64(0xFFFFFFFF)).astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16)]))
                shard.append(int(s))
        return pa.record_batch([pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], ["shard", "data"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, limit):
            yield block(table)

    return send


def _settle(window: int):
    """Of the windows sent to one shard: all but the earliest of each kind, as spans."""

    def out(doc, sha, start, end):
        for i in range(0, len(doc), 100_000):
            j = i + 100_000
            yield pa.record_batch([pa.array(doc[i:j], pa.int64()), pa.array(sha[i:j], pa.int64()), pa.array(start[i:j], pa.int32()), pa.array(end[i:j], pa.int32())], ["doc_id", "text_sha", "first", "end"])

    def one(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = []
        for blob in blobs:
            x = unpack(blob)
            if x[0].dtype == np.int8:
                yield from out(*x[1:])
            else:
                rows.append(x)
        if not rows:
            return
        key, doc, sha, pos, size, offset, low, high = (np.concatenate(x) for x in zip(*rows, strict=True))
        del rows
        # An anchor seen once has no match to extend.
        _, kind, seen = np.unique(key, return_inverse=True, return_counts=True)
        chosen = np.flatnonzero(seen[kind] > 1)
        chosen = chosen[np.lexsort((pos[chosen], sha[chosen], doc[chosen]))]
        doc, sha = doc[chosen], sha[chosen]
        size = size.astype(np.int64)
        each = size[chosen]
        row = np.repeat(starts_of(size)[:-1][chosen], each) + within(each)
        tail = low[row].astype(np.uint64) | high[row].astype(np.uint64) << np.uint64(32)
        anchor = np.repeat(kind[chosen], each)
        start = np.repeat(pos[chosen], each) - offset[row]
        where = np.repeat(_places(doc, sha), each)
        by = np.lexsort((tail, anchor))
        anchor, tail, start, where = anchor[by], tail[by], start[by], where[by]
        same = np.zeros(len(anchor), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (tail[1:] == tail[:-1])
        if len(same):
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
            same &= (where != where[head]) | (start != start[head])
        row, first, end = runs(where[same], start[same], window)
        yield from out(doc[row], sha[row], first, end)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != of and held:
                    yield from one(held)
                    held = []
                of = s
                held.append(blob)
        yield from one(held)

    return settle


def repeats(docs: DataFrame, window: int = 20, k: int = 8) -> DataFrame:
    """(doc_id, text_sha, first, end): word spans whose every window also starts earlier; spans of one document may overlap."""
    if not 0 < k <= window <= 256:
        raise ValueError("0 < k <= window <= 256")
    shards = shard_count(docs.sparkSession)
    sent = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_sha")).mapInArrow(_send(window, k, shards, block_bytes(docs.sparkSession, BLOCK_BYTES)), "shard int, data binary")
    return dealt(sent).mapInArrow(_settle(window), "doc_id long, text_sha long, first int, end int")


def _cut(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, BLOCK_BYTES):
            words = Words(column(table, "text"))
            firsts, ends = (column(table, x).fill_null([]) for x in ("firsts", "ends"))
            each = np.diff(firsts.offsets.to_numpy())
            base, close = np.repeat(words.at[:-1], each), np.repeat(words.at[1:], each)
            step = np.zeros(len(words.code) + 1, np.int64)
            np.add.at(step, np.minimum(base + firsts.flatten().to_numpy(zero_copy_only=False), close), 1)
            np.add.at(step, np.minimum(base + ends.flatten().to_numpy(zero_copy_only=False), close), -1)
            gone = np.cumsum(step[:-1]) > 0
            removed, left = starts_of(gone)[words.at], starts_of(~gone)[words.at]
            names = np.empty(len(words.distinct), object)
            names[:] = words.distinct.to_pylist()
            kept = names[words.code[~gone]].tolist()
            texts = [" ".join(kept[a:b]) for a, b in zip(left[:-1], left[1:], strict=True)]
            out = [column(table, "doc_id"), pa.array(words.counts), pa.array(np.diff(removed)), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())]
            yield pa.record_batch([*out, *([pa.array(texts, pa.string())] if with_text else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text])

    return cut


def substring_dedup(docs: DataFrame, window: int = 20, k: int = 8, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (its kept words joined by one space)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeats(docs, window, k).groupBy(F.col("doc_id").alias("at_id"), F.col("text_sha").alias("at_sha")).agg(F.collect_list("first").alias("firsts"), F.collect_list("end").alias("ends"))
    held = docs.join(spans, (F.coalesce("doc_id", F.lit(NO_ID)) == spans.at_id) & (F.xxhash64("text") == spans.at_sha), "left").drop("at_id", "at_sha")
    return held.mapInArrow(_cut(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
