"""An exact n-gram Jaccard join with count vectors in an R-tree, and its connected components.

A document is the set of its distinct word n-grams. Equal sets are one class, which stands for all its
documents. The hashes of a set are also dealt to groups; the numbers in each group are a point,
and the sum of the smaller coordinates of two points bounds the overlap of their sets. Points that may match
are found with an R-tree whose boxes keep the largest coordinate of what is below: if even the boxes' sum of
minima is less than the overlap that the threshold asks for, all their pairs are dropped at once. Pairs that
are left are verified on the sets themselves.

One tree over everything would compare boxes with boxes quadratically, as points of unlike documents lie
close together in so many dimensions. So trees are built over routes: two sets that reach the threshold
share one of their ``n - ceil(t n) + 1`` smallest hashes, and sizes that differ by less than the factor t lie in
one size band or next to its border. A route is such a hash with a band; its classes form one tree.

A route with two classes names one pair, which is tried if the two can share enough routes. In the tree of a
larger route every class finds the other that its bound brings nearest, if any reaches the threshold. These
pairs are verified first, and links are joined to components. Then the trees are searched again, over the
places that had any partner and routes with several components: once for each place's nearest partner in
another component, and, when these are verified, for all pairs of different components. So
thousands of near copies, which are one component by then, never become all their pairs; and every pair of
classes over the threshold is at the end either verified itself or inside one component. As hashes are
sorted, the first that two sets share stands behind misses only, so a pair is looked at only in routes that
stand early enough in both.

A route of very many classes, such as one of a very common line, is dealt to parts, and each two parts, and each
part with itself, are a tree of their own, so that its pairs are spread over tasks.

Defined cases: a document without words, or of null text, has an empty set and is linked with nothing; rows
that repeat are members of one class; rows without a ``doc_id`` link like others and have the smallest id of
their component, null if it has none; extra columns are ignored. Classes have numbers of 64 bits and are checked by
64 more: sets that share a number but not the check, which about 10^10 documents make likely, are an error.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.exchange import block_bytes, cuts, dealt, pack, shard_count, unpack, written
from folioscan.llm.textblocks import Words, blocks, column, grams, mix, starts_of, within

BLOCK_BYTES = 6 << 20
#: A point has about one coordinate for so many elements, as a power of two within these bounds.
PER_GROUP, LEAST_GROUPS, MOST_GROUPS = 2, 64, 1 << 14
#: Seed of the second number of a set.
CHECK = 0x9FB21C651E98DF25
#: More than there are size bands.
BANDS = 256
#: Points in a leaf of a tree, and children of a node.
LEAF = 32
#: Classes of a route that are not yet dealt to parts.
MOST_IN_TREE = 1024
#: Rows of two numbers that are broadcast at most.
MOST_BROADCAST = 1 << 19
#: Pairs that a tree looks at together.
STEP = 1 << 14
#: Members that one task verifies against a centre at a time.
CHUNK = 256
_U = np.uint64


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes, where each text's begin); of fewer than n words all words are one n-gram."""
    words = Words(texts, fold=True)
    own = words.hashes(7)[words.code]
    counts = words.counts
    gram = grams(own, n)
    each = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = starts_of(each)
    doc = np.repeat(np.arange(len(counts)), each)
    out = np.empty(at[-1], _U)
    long = np.repeat(counts >= n, each)
    source = np.repeat(words.at[:-1], each) + within(each)
    out[long] = gram[source[long]]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        a, b = words.at[d], words.at[d + 1]
        out[at[d]] = grams(own[a:b], b - a)[0] ^ _U(b - a)
    for d in np.flatnonzero(each > 1):
        out[at[d] : at[d + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], starts_of(np.bincount(doc[new], minlength=len(counts)))


def set_ids(hashes: np.ndarray, at: np.ndarray, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """One number for each set, by its content; 0 for the empty set."""
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(mix(hashes ^ _U(seed)), out=total[1:], dtype=_U)
    size = np.diff(at).astype(_U)
    return np.where(size > 0, mix((total[at[1:]] - total[at[:-1]]) + size * _U(0x9E3779B97F4A7C15)) | _U(1), _U(0))


@functools.cache
def group_count(band: int, percent: int) -> int:
    """Coordinates of the points of a size band, from the sizes it ends with."""
    top = math.exp((band + 1) * 4 * math.log(100 / percent)) / PER_GROUP
    return int(min(MOST_GROUPS, max(LEAST_GROUPS, 1 << math.ceil(math.log2(max(top, 1))))))


@functools.cache
def _codec():
    """Of each process: counts take two or three bits of a byte, and points travel with every route."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def point(hashes: np.ndarray, groups: int) -> bytes:
    """Group counts of a set, compressed; bytes if they are small, else four bytes each."""
    found = np.bincount((mix(hashes) >> _U(64 - int(math.log2(groups)))).astype(np.int64), minlength=groups)
    return _codec()[0].compress(found.astype(np.uint8 if found.max(initial=0) < 256 else np.uint32).tobytes())


def read_point(data: bytes, stored: int, groups: int) -> np.ndarray:
    """The point in ``groups`` coordinates, at most as many as are stored: neighbours are added up."""
    data = _codec()[1].decompress(data)
    found = np.frombuffer(data, np.uint8 if len(data) == stored else np.uint32)
    return found if len(found) == groups else found.reshape(groups, -1).sum(1, dtype=np.uint32)


def needed(a, b, percent: int):
    """The overlap with which sets of these sizes reach the threshold, rounded up."""
    return -(-(percent * (a + b)) // (100 + percent))


def shared_routes(a, b, percent: int):
    """How many routes two sets of these sizes share at least if they reach the threshold.

    Of a set's first p hashes at most n - overlap are missing in the other; for the set whose first hashes
    end earlier, those that are not missing are among the other's first hashes.
    """
    least = needed(a, b, percent)
    own = lambda n: n - -(-percent * n // 100) + 1 - (n - least)
    return np.maximum(1, np.minimum(own(a), own(b)))


def bands(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(size band, whether the next band up may hold partners)."""
    width = 4 * math.log(100 / percent)
    place = np.log(np.maximum(size, 1)) / width
    band = np.floor(place).astype(np.int64)
    return band, np.floor((np.log(np.maximum(size, 1)) + math.log(100 / percent) + 1e-9) / width).astype(np.int64) > band


def _routes(n: int, percent: int, shards: int, limit: int = BLOCK_BYTES):
    """Each block's members and classes with their points, as rows; their routes packed by shard."""

    def block(table: pa.Table) -> pa.RecordBatch:
        hashes, at = shingle_sets(column(table, "text"), n)
        ids, again, size = set_ids(hashes, at), set_ids(hashes, at, CHECK), np.diff(at)
        doc_id, sha = column(table, "doc_id"), column(table, "text_sha").to_numpy(zero_copy_only=False)
        none = doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        shard, blob = [0], [pack([np.zeros(1, np.int8), ids, doc_id.fill_null(0).to_numpy(zero_copy_only=False), none, size.astype(np.int32), sha, again.view(np.int64)])]
        own, first = np.unique(ids, return_index=True)
        first = first[own != 0]
        # Of the members of a class only one sends routes and a point.
        band, upper = bands(size[first], percent)
        data = [point(hashes[at[d] : at[d + 1]], group_count(int(k), percent)) for d, k in zip(first, band + upper, strict=True)]
        if len(first):
            shard.append(0)
            blob.append(pack([np.ones(1, np.int8), ids[first], size[first].astype(np.int32), np.array([len(x) for x in data], np.int32), np.frombuffer(b"".join(data), np.uint8)]))
        prefix = size[first] - -(-percent * size[first] // 100) + 1
        row = np.repeat(at[first], prefix) + within(prefix)
        which = np.repeat(first, prefix)
        band, upper, place = np.repeat(band, prefix), np.repeat(upper, prefix), within(prefix)
        token = hashes[row]
        route = np.concatenate([mix(token + band.astype(_U)), mix(token[upper] + band[upper].astype(_U) + _U(1))])
        which, band, place = np.concatenate([which, which[upper]]), np.concatenate([band, band[upper] + 1]), np.concatenate([place, place[upper]])
        by = np.argsort(route, kind="stable")
        route, which, other = route[by], which[by], (place * BANDS + band)[by]
        edge = cuts(route, shards)
        for s in np.flatnonzero(np.diff(edge)):
            part = slice(edge[s], edge[s + 1])
            shard.append(int(s))
            blob.append(pack([route[part], ids[which[part]], size[which[part]].astype(np.int32), other[part].astype(np.int32)]))
        shard[0] = int(ids[0] % _U(shards)) if len(ids) else 0
        if len(first):
            shard[1] = shard[0]
        return pa.record_batch([pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], ["shard", "data"])

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, limit):
            yield block(table)

    return routes


FOUND = "kind int, id long, value long, size int, other int, point binary, text_sha long, again long"


def _shared(percent: int):
    """Of a shard, rows of FOUND: members (0: id, value doc_id, size, hash of the text, check of the id), classes (1: id, size, point), pairs of routes
    with two classes (2: id, value the other's id, both sizes), and classes of larger routes (3: id, value route,
    size, other the hash's place in the set times BANDS, plus the size band). Classes without a partner of a fitting size in their route are left out."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def rows(kind, ids, value, size, other, data=None, marks=()):
        for k in range(0, len(ids), 20_000):
            part = slice(k, k + 20_000)
            count = len(ids[part])
            value_ = value[part] if isinstance(value, pa.Array) else pa.array(value[part].view(np.int64))
            yield pa.record_batch([pa.array(np.full(count, kind, np.int32)), pa.array(ids[part].view(np.int64)), value_, pa.array(size[part].astype(np.int32)), pa.array(other[part].astype(np.int32)), pa.nulls(count, pa.binary()) if data is None else pa.array(data[part], pa.binary()), *([pa.array(x[part]) for x in marks] or [pa.nulls(count, pa.int64())] * 2)], names)

    def one(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        held = []
        for blob in blobs:
            x = unpack(blob)
            if x[0].dtype == np.int8 and x[0][0] == 0:
                yield from rows(0, x[1], pa.array(x[2], mask=x[3].astype(bool)), x[4], np.zeros(len(x[1])), None, x[5:])
            elif x[0].dtype == np.int8:
                cut, data = starts_of(x[3]), x[4].tobytes()
                yield from rows(1, x[1], x[1], x[2], np.zeros(len(x[1])), [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
            else:
                held.append(x)
        if not held:
            return
        route, ids, size, other = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((ids, size, route))
        route, ids, size, other = route[by], ids[by], size[by].astype(np.int64), other[by]
        new = np.ones(len(ids), bool)
        new[1:] = (route[1:] != route[:-1]) | (ids[1:] != ids[:-1]) | (size[1:] != size[:-1])
        route, ids, size, other = route[new], ids[new], size[new], other[new]
        near = (route[1:] == route[:-1]) & (size[:-1] * 100 >= percent * size[1:])
        fits = np.zeros(len(ids), bool)
        fits[1:] |= near
        fits[:-1] |= near
        route, ids, size, other = route[fits], ids[fits], size[fits], other[fits]
        cut = np.flatnonzero(np.append(True, route[1:] != route[:-1])) if len(route) else np.zeros(0, np.int64)
        count = np.diff(np.append(cut, len(route)))
        two = cut[count == 2]
        swap = ids[two] > ids[two + 1]
        a, b = np.where(swap, two + 1, two), np.where(swap, two, two + 1)
        yield from rows(2, ids[a], ids[b], size[a], size[b])
        more = np.repeat(count > 2, count)
        yield from rows(3, ids[more], route[more], size[more], other[more])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != of and held:
                    yield from one(held)
                    held = []
                of = s
                held.append(blob)
        yield from one(held)

    return shared


class CountTree:
    """A packed R-tree of count vectors; boxes keep the largest coordinates, as minima of sums need only these."""

    def __init__(self, vectors: np.ndarray, size: np.ndarray, place: np.ndarray | None = None):
        # Along the size first, as the threshold bounds it; then by the first coordinates, so boxes stay small.
        self.order = np.lexsort((*vectors[:, :3].T, size))
        self.vectors, self.size = vectors[self.order], size[self.order].astype(np.int64)
        self.place = np.zeros(len(size), np.int64) if place is None else place[self.order]
        self.levels = [(self.vectors, self.size, self.size)]
        while len(self.levels[-1][0]) > LEAF or len(self.levels) == 1:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
        # Of a point the sum behind its first quarter of coordinates.
        self.quarter = vectors.shape[1] // 4
        self.rest = self.vectors[:, self.quarter :].sum(1, dtype=np.int64)

    def survivors(self, percent: int, apart: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (i, j) of the points given whose bound reaches the threshold and whose ``apart`` differ, and whose
        ``side`` differs if it is given, with the bound, in parts. Nodes are gone through in parts too, so that memory
        stays small for any number of points."""
        apart = apart[self.order]
        self.side = None if side is None else side[self.order]
        top = len(self.levels) - 1
        count = len(self.levels[top][0])
        a, b = np.triu_indices(count)
        yield from self._within(top, a.astype(np.int64), b.astype(np.int64), percent, apart)

    def _within(self, level: int, a: np.ndarray, b: np.ndarray, percent: int, apart: np.ndarray):
        top, low, high = self.levels[level]
        for k in range(0, len(a), STEP):
            x, y = a[k : k + STEP], b[k : k + STEP]
            # Some sizes within must fit, and the sum of minima reach the least overlap that they ask for.
            fits = (high[y] * 100 >= percent * low[x]) & (high[x] * 100 >= percent * low[y])
            least = needed(low[x], low[y], percent)
            if level == 0:
                fits &= (x < y) & (apart[x] != apart[y]) & (self.place[x] <= self.size[x] - least) & (self.place[y] <= self.size[y] - least)
                if self.side is not None:
                    fits &= self.side[x] != self.side[y]
                i = np.flatnonzero(fits)
                part = np.minimum(top[x[i], : self.quarter], top[y[i], : self.quarter]).sum(1, dtype=np.int64)
                i = i[part + np.minimum(self.rest[x[i]], self.rest[y[i]]) >= least[i]]
            else:
                i = np.flatnonzero(fits)
            bound = np.minimum(top[x[i]], top[y[i]]).sum(1, dtype=np.int64)
            good = bound >= least[i]
            i, bound = i[good], bound[good]
            if level == 0:
                if len(i):
                    yield self.order[x[i]], self.order[y[i]], bound
            elif len(i):
                # A node pair has LEAF * LEAF pairs below.
                for m in range(0, len(i), max(1, STEP // LEAF)):
                    part = i[m : m + max(1, STEP // LEAF)]
                    yield from self._within(level - 1, *self._below(x[part], y[part], len(self.levels[level - 1][0])), percent, apart)

    @staticmethod
    def _below(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The children's pairs of pairs of nodes, each unordered pair once."""
        step = np.arange(LEAF)
        x = (a[:, None, None] * LEAF + step[None, :, None]) + np.zeros((1, 1, LEAF), np.int64)
        y = (b[:, None, None] * LEAF + step[None, None, :]) + np.zeros((1, LEAF, 1), np.int64)
        x, y = x.ravel(), y.ravel()
        good = (x < count) & (y < count) & (x <= y)
        return x[good], y[good]


def nearest(tree: CountTree, percent: int, apart: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """For each point the one of another ``apart`` whose bound gives the largest similarity, -1 if none reaches the threshold."""
    count = len(tree.size)
    size = np.empty(count, np.int64)
    size[tree.order] = tree.size
    best, other = np.zeros(count), np.full(count, -1)
    for i, j, bound in tree.survivors(percent, apart, side):
        score = bound / (size[i] + size[j] - bound)
        row, partner, score = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([score, score])
        by = np.lexsort((partner, score, row))
        last = by[np.append(row[by][1:] != row[by][:-1], True)]
        better = score[last] > best[row[last]]
        row, last = row[last][better], last[better]
        best[row], other[row] = score[last], partner[last]
    return other


@functools.lru_cache(1 << 16)
def _stored(size: int, percent: int) -> int:
    """Coordinates of the stored point of a set of this size."""
    band, upper = bands(np.array([size]), percent)
    return group_count(int(band[0] + upper[0]), percent)


def _bounded(percent: int):
    """Of pairs with both points those whose bound reaches the threshold."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (column(batch, x).to_numpy() for x in ("size_a", "size_b"))
            keep = np.zeros(len(na), bool)
            for k, (x, y, p, q) in enumerate(zip(na, nb, column(batch, "point_a").to_pylist(), column(batch, "point_b").to_pylist(), strict=True)):
                s, t = _stored(int(x), percent), _stored(int(y), percent)
                groups = min(s, t)
                keep[k] = np.minimum(read_point(p, s, groups), read_point(q, t, groups)).sum(dtype=np.int64) >= needed(int(x), int(y), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return bounded


def _searched(percent: int, every: bool):
    """Rows sorted by tree, with the classes of one tree together: those of a route, or of two parts of it, its sides.

    Each class's nearest partner of another component (kind 0, a, b), and the places that had one (kind 1, id,
    route); with ``every``, all pairs of different components (kind 0).
    """

    def one(ids, size, place, apart, vectors, route, side):
        tree = CountTree(vectors, size, place)
        if not every:
            other = nearest(tree, percent, apart, side)
            i = np.flatnonzero(other >= 0)
            pairs = np.unique(np.sort(np.stack([ids[i], ids[other[i]]], 1), axis=1), axis=0)
            alive = np.unique(np.concatenate([i, other[i]]))
            yield 0, pairs[:, 0], pairs[:, 1]
            yield 1, ids[alive], np.full(len(alive), route)
        else:
            for i, j, _ in tree.survivors(percent, apart, side):
                yield 0, np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    def out(held: list[list]) -> pa.RecordBatch:
        rows = np.unique(np.stack([np.concatenate(v).astype(np.int64) for v in held], 1), axis=0)
        return pa.record_batch([pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["kind", "a", "b"])

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        name, route, ids, size, apart, other, sides = (column(table, x).to_numpy() for x in ("tree", "route", "id", "size", "component", "other", "side"))
        data = column(table, "point")
        cut = np.append(np.flatnonzero(np.append(True, name[1:] != name[:-1])), len(name))
        held: list[list] = [[], [], []]
        count = 0
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            side = None if sides[a] < 0 else sides[a:b]
            if (apart[a:b] == apart[a]).all() or side is not None and (side == side[0]).all():
                continue
            groups = group_count(int(other[a] % BANDS), percent)
            vectors = np.stack([read_point(x, _stored(int(n), percent), groups) for x, n in zip(data[a:b].to_pylist(), size[a:b].tolist(), strict=True)])
            for kind, x, y in one(ids[a:b], size[a:b], other[a:b] // BANDS, apart[a:b], vectors, route[a], side):
                for own, v in zip(held, (np.full(len(x), kind, np.int32), x, y), strict=True):
                    own.append(v)
                count += len(x)
                if count > 200_000:
                    yield out(held)
                    held, count = [[], [], []], 0
        if count:
            yield out(held)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            name = column(table, "tree").to_numpy()
            last = int(np.searchsorted(name, name[-1])) if len(name) else 0
            if last:
                yield from settle(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield from settle(rest)

    return searched


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The number of common elements of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int(np.count_nonzero(a[at] == b))


def _verified(n: int, percent: int):
    """Rows sorted by centre, chunk and role: the centre's text comes first, then each member's."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = None, None
        for table in blocks(batches, BLOCK_BYTES):
            hashes, at = shingle_sets(column(table, "text"), n)
            ids = set_ids(hashes, at).view(np.int64)
            a, b = [], []
            for k, (centre, chunk, role, other) in enumerate(zip(*(column(table, x).to_pylist() for x in ("centre", "chunk", "role", "id")), strict=True)):
                if ids[k] != other:  # another row with the document id of the class
                    continue
                value = hashes[at[k] : at[k + 1]]
                if role == 0:
                    of, own = (centre, chunk), value.copy()
                elif of == (centre, chunk):
                    common = overlap(own, value)
                    if 100 * common >= percent * (len(own) + len(value) - common):
                        a.append(centre)
                        b.append(other)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verified


def _texts(docs: DataFrame) -> DataFrame:
    """(none, first_doc, text_sha, text): the texts by what classes know them by. Rows without an id are one for each text."""
    own = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("first_doc"), F.xxhash64("text").alias("text_sha"), "text")
    nameless = own.where("none").groupBy("none", "first_doc", "text_sha").agg(F.first("text").alias("text"))
    return own.where("not none").unionByName(nameless)


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those that reach the threshold, in either order. Of a pair the class of more pairs
    is the centre, which is sent once to each chunk of about CHUNK members."""
    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("pairs"))
    told = pairs.join(ends.select(F.col("id").alias("a"), F.col("pairs").alias("of_a")), "a").join(ends.select(F.col("id").alias("b"), F.col("pairs").alias("of_b")), "b")
    turn = F.col("of_b") > F.col("of_a")
    pairs = told.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    members = pairs.join(chunks, "a").select(F.col("b").alias("id"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"))
    centres = chunks.select(F.col("a").alias("id"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"))
    sends = members.unionByName(centres).join(classes.select("id", "none", "first_doc", "text_sha"), "id")
    sends = written(sends, "sends")
    # Texts that no pair needs stay where they are, if those that are needed can be told to every task.
    wanted = sends.select("text_sha").distinct()
    own = _texts(docs)
    if wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        own = own.join(F.broadcast(wanted), "text_sha", "left_semi")
    texts = own.join(sends, ["first_doc", "text_sha", "none"]).select("id", "centre", "chunk", "role", "text")
    return texts.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "role").mapInArrow(_verified(n, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the nodes of links (a, b), the component named by its smallest node.

    Each round hooks every root to the smallest of its neighbours' roots, follows the hooks twice, and
    contracts the links; the tables of each round are written to the shared folder.
    """
    edges = written(links.select("a", "b").distinct(), "links")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    names = written(nodes.select("id", F.col("id").alias("component")), "names")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("root"), F.least("a", "b").alias("up"))
        for _ in range(2):
            over = hooks.select(F.col("root").alias("up"), F.col("up").alias("over"))
            hooks = hooks.join(over, "up", "left").select("root", F.coalesce("over", "up").alias("up"))
        hooks = written(hooks, "hooks")
        names = written(names.join(hooks, names.component == hooks.root, "left").select("id", F.coalesce("up", "component").alias("component")), "names")
        first = edges.join(hooks, edges.a == hooks.root).select(F.col("up").alias("a"), "b")
        second = first.join(hooks, first.b == hooks.root).select("a", F.col("up").alias("b"))
        edges = written(second.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return names


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that their points do not rule out."""
    side = lambda x: points.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("point").alias(f"point_{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded(percent), "a long, b long")


def _parts(routes: DataFrame) -> DataFrame:
    """(route, parts) of the routes of more than MOST_IN_TREE classes; broadcast if they are few."""
    found = written(routes.groupBy("route").agg(F.ceil(F.count(F.lit(1)) / MOST_IN_TREE).cast("int").alias("parts")).where("parts > 1"), "parts")
    return F.broadcast(found) if found.count() <= MOST_BROADCAST else found


def _trees(routes: DataFrame, parts: DataFrame, points: DataFrame, percent: int, every: bool) -> DataFrame:
    """The search of every route's tree. Rows: id, route, size, other, component."""
    own = routes.join(parts, "route", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    ready = own.join(points.select("id", "point"), "id")
    # A part meets each part, itself included.
    ready = ready.withColumn("met", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    pair = F.least("part", "met"), F.greatest("part", "met")
    tree = F.when(F.col("parts").isNull(), F.col("route")).otherwise(F.xxhash64("route", *pair))
    side = F.when(F.col("parts").isNull() | (F.col("part") == F.col("met")), -1).otherwise((F.col("part") < F.col("met")).cast("int"))
    ready = ready.select(tree.alias("tree"), "route", "id", "size", "component", "other", side.alias("side"), "point")
    return ready.repartition("tree").sortWithinPartitions("tree", "size", "id").mapInArrow(_searched(percent, every), "kind int, a long, b long")


def linked_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach), class_id, text_sha (its xxhash64)."""
    spark = docs.sparkSession
    shards = shard_count(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.withColumn("text_sha", F.xxhash64("text")).mapInArrow(_routes(n, percent, shards, block_bytes(spark, BLOCK_BYTES)), "shard int, data binary")
    found = written(dealt(sent).mapInArrow(_shared(percent), FOUND), "routes")
    members = found.where("kind = 0").select("id", F.col("value").alias("doc_id"), "size", "text_sha", "again")
    # The text of a class is that of its member with the smallest id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("first_doc"), "text_sha"))
    checked = F.when(F.min("again") == F.max("again"), first).otherwise(F.raise_error(F.lit("two different sets have one class number")))
    classes = members.where("id <> 0").groupBy("id").agg(checked.alias("first")).select("id", "first.*")
    points = found.where("kind = 1").groupBy("id").agg(F.first("size").alias("size"), F.first("point").alias("point"))
    routes = found.where("kind = 3").select("id", F.col("value").alias("route"), "size", "other")
    # Pairs of routes with two classes: they must share enough routes, larger ones counted as shared.
    larger = routes.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    twos = found.where("kind = 2").groupBy(F.col("id").alias("a"), F.col("value").alias("b")).agg(F.count(F.lit(1)).alias("own"), F.first("size").alias("size_a"), F.first("other").alias("size_b"))
    twos = twos.join(larger.select(F.col("id").alias("a"), F.col("n").alias("more_a")), "a", "left").join(larger.select(F.col("id").alias("b"), F.col("n").alias("more_b")), "b", "left")
    most = F.col("own") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    twos = bounded(twos.where(most >= _least_routes(percent)).select("a", "b"), points, percent)
    # Larger routes: each class's nearest partner.
    parts = _parts(routes)
    near = written(_trees(routes.withColumn("component", F.col("id")), parts, points, percent, False), "near")
    tried = written(near.where("kind = 0").select("a", "b").unionByName(twos).distinct(), "pairs")
    links = written(verify(docs, tried, classes, n, percent), "links")
    names = components(links)
    # Different components, in the routes and places that had any partner.
    alive = near.where("kind = 1").select(F.col("a").alias("id"), F.col("b").alias("route"))
    places = written(routes.join(alive, ["id", "route"], "left_semi"), "places")
    for every in (False, True):
        told = places.join(names, "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_ = told.groupBy("route").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("route")
        found_ = _trees(told.join(open_, "route", "left_semi"), parts, points, percent, every).where("kind = 0").select("a", "b").distinct()
        pairs = written(written(found_, "found").join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.union(written(verify(docs, pairs, classes, n, percent), "links"))
        names, tried = components(links), tried.union(pairs)
    placed = members.join(names, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.where("id <> 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "component", "left")
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("id") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("id").alias("class_id"), "text_sha")


def _least_routes(percent: int):
    """shared_routes() of the columns size_a and size_b."""
    a, b = F.col("size_a").cast("long"), F.col("size_b").cast("long")
    up = lambda x, by: F.floor((x + by - 1) / by)  # noqa: E731  exact below 2^53
    least = up((a + b) * percent, 100 + percent)
    own = lambda n: n - up(n * percent, 100) + 1 - (n - least)
    return F.greatest(F.lit(1), F.least(own(a), own(b)))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns; those without an id stay.

    Rows that share an id are told apart by their texts.
    """
    drop = linked_components(docs, n, percent).where("component_id < doc_id").select(F.col("doc_id").alias("id"), F.col("text_sha").alias("sha")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("sha"), F.struct("*").alias("row"))
    return rows.join(drop, ["id", "sha"], "left_anti").select("row.*")
