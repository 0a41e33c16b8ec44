"""Language-model scoring by a weighted backoff automaton, trained on the corpus itself.

States are the histories that occur in training, the empty one included; an arc of a state is a word that
follows it there, and its failure arc leads to the history without its first word. With c(h w) counted in
training and m prior counts, an arc weighs log10((c(h w) + m p(w | shorter h)) / (c(h) + m)) and a failure arc
log10(m / (c(h) + m)), so that all words of a state add up to one. The empty state has an arc for each word, with
its smoothed probability (c(w) + 1/2) / (N + (V + 1) / 2). A text is read once, from left to right: its state is
carried from token to token, failure arcs are taken until the state has an arc for the token, and the weights
on the way are added up.

Counts grow with the corpus and are never held whole. Texts are coded once, as compressed blocks of word
numbers, and written to the shared folder. A block counts its own n-grams and sends them to shards by their
hashes; a shard adds up the counts of all blocks and answers each block with those of its n-grams that other
blocks hold too, as one bit for each n-gram that the block sent and the sums of the marked ones. So each block
gets the part of the automaton that its own texts can reach, and nothing is cut off or sampled.

Defined cases: null text is empty, one end token; the rows of one ``doc_id`` are on one side of the split;
a null ``doc_id`` is the text "" for the split; without training tokens all scores follow from N = 0; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.exchange import block_bytes, cuts, dealt, pack, shard_count, unpack, written
from folioscan.llm.textblocks import Words, column, mix, starts_of
from folioscan.llm.textblocks import blocks as text_blocks

#: Prior counts of the shorter history for histories of one and two words.
PRIOR = (4.0, 2.0)
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Bytes of text that a block holds; a longer text is a block of its own.
BLOCK_BYTES = 3 << 20
#: The place of a block's texts before the answers that shards send it.
TEXTS = -1
_U = np.uint64


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct token, number of each token among them, where each text's begin); an end token closes each text."""
    words = Words(texts, fold=True)
    counts = words.counts
    at = starts_of(counts + 1)
    own = words.hashes(11)
    own[own == END] = BEGIN ^ END
    code = np.full(at[-1], len(own), np.int32)
    code[np.arange(len(words.code)) + np.repeat(np.arange(len(counts)), counts)] = words.code
    return np.append(own, END), code, at


def ngrams(token: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order the key of the n-gram that ends at each token; begin marks stand before a text."""
    place = np.arange(len(token)) - np.repeat(at[:-1], np.diff(at))
    keys, key = [], mix(token)
    for n in range(1, order + 1):
        if n > 1:
            before = np.full_like(token, BEGIN)
            before[n - 1 :] = token[: max(len(token) - n + 1, 0)]
            before[place < n - 1] = BEGIN
            key = mix(key * _U(0x9E3779B97F4A7C15) + before)
        keys.append(key ^ _U(n))
    return keys


def openings(order: int) -> np.ndarray:
    """The keys of the histories of n - 1 begin marks, for n = 2 .. order."""
    return BEGIN ^ np.arange(2, order + 1, dtype=_U)


def held_out(doc_id: pa.Array, fold: int, folds: int) -> np.ndarray:
    return np.array([zlib.crc32(("" if x is None else str(x)).encode()) % folds == fold for x in doc_id.to_pylist()], bool)


class Block:
    """Coded texts: word hashes, codes, text ends, ids; and the distinct n-grams they are made of.

    kind: the sorted keys of all n-grams and openings; gram: for n = 1 .. order the number in kind of the
    n-gram that ends at each token; opening: the number in kind of each opening.
    """

    def __init__(self, own: np.ndarray, code: np.ndarray, at: np.ndarray, order: int):
        self.code, self.at, self.order, self.words = code, at, order, len(own)
        keys = ngrams(own[code], at, order)
        self.kind, place = np.unique(np.concatenate([*keys, openings(order)]), return_inverse=True)
        self.gram = [place[k * len(code) : (k + 1) * len(code)] for k in range(order)]
        self.opening = place[order * len(code) :]

    def counted(self, out: np.ndarray) -> np.ndarray:
        """How often each n-gram stands in the texts that are not held ``out``; an opening stands once in a text."""
        train = np.repeat(~out, np.diff(self.at))
        n = np.zeros(len(self.kind), np.int64)
        for gram in self.gram:
            n += np.bincount(gram[train], minlength=len(n))
        n[self.opening] += np.count_nonzero(~out)
        return n


def _coded(fold: int, folds: int, limit: int):
    """Texts as blocks (block, data): ids, sides of the split, word hashes, codes and ends."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, table in enumerate(text_blocks(batches, limit)):
            ids = column(table, "doc_id")
            own, code, at = tokens(column(table, "text"))
            data = pack([own, code, at, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), held_out(ids, fold, folds)])
            yield pa.record_batch([pa.array([task + k], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])

    return coded


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(x.as_py() for x in row)


def _grouped(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in their first value."""
    held: list[tuple] = []
    for row in rows:
        if held and row[0] != held[0][0]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _counted(order: int, shards: int):
    """A block's n-grams with their counts in its training texts, packed by shard."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data in _rows(batches):
            own, code, at, _, _, out = unpack(data)
            held = Block(own, code, at, order)
            n = held.counted(out).astype(np.uint32)
            # Words carry a mark, so that shards can count them.
            word = np.zeros(len(n), np.uint8)
            word[held.gram[0]] = 1
            edge = cuts(held.kind, shards)
            full = np.flatnonzero(np.diff(edge))
            parts = (slice(edge[s], edge[s + 1]) for s in full)
            blob = [pack([held.kind[p], n[p], word[p]]) for p in parts]
            yield pa.record_batch([pa.array(full, pa.int32()), pa.array(np.full(len(full), block), pa.int64()), pa.array(blob, pa.binary())], ["shard", "block", "data"])

    return counted


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's sums: to each block a bit for each n-gram it sent, set if others have more of it, and the sums of
    those; and one row without a block of the shard's word tokens and distinct words."""
    for rows in _grouped(_rows(batches)):
        shard = rows[0][0]
        parts = [unpack(data) for _, _, data in rows]
        key, n, word = (np.concatenate([p[k] for p in parts]) for k in range(3))
        edge = starts_of(np.array([len(p[0]) for p in parts]))
        del parts
        kind, place = np.unique(key, return_inverse=True)
        total = np.bincount(place, n, len(kind)).astype(np.int64)
        is_word = np.zeros(len(kind), bool)
        is_word[place[word == 1]] = True
        more = total[place] > n
        names, blob = [None], [pack([np.array([total[is_word].sum(), np.count_nonzero(is_word & (total > 0))], np.int64)])]
        for i, (_, block, _) in enumerate(rows):
            own = slice(edge[i], edge[i + 1])
            names.append(block)
            sums = total[place[own]][more[own]]
            blob.append(pack([np.packbits(more[own]), np.minimum(sums, 255).astype(np.uint8), sums[sums >= 255]]))
        yield pa.record_batch([pa.array(names, pa.int64()), pa.array([shard] * len(names), pa.int32()), pa.array(blob, pa.binary())], ["block", "shard", "data"])


class Automaton:
    """The part of the model that a block's texts reach, as states, arcs and failure arcs.

    States are numbered from 1 by the order of their histories' keys; 0 is the empty history.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, kinds: int, order: int):
        by = np.argsort(keys)
        self.keys, self.counts, self.total, self.kinds, self.order = keys[by], counts[by], total, kinds, order

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)

    def build(self, held: Block) -> None:
        """States and arcs for the n-grams of a block."""
        c, size, code, words = self.count(held.kind), len(held.kind), held.code, held.words
        first = np.zeros(len(code), bool)
        first[held.at[:-1][np.diff(held.at) > 0]] = True
        # Of each n-gram one place where it ends; its word, history and shorter form are read there.
        some = [np.full(size, -1) for _ in range(self.order)]
        for n, gram in enumerate(held.gram):
            some[n][gram] = np.arange(len(code))
        p = np.zeros(size)
        own = np.flatnonzero(some[0] >= 0)
        p[own] = (c[own] + 0.5) / (self.total + 0.5 * (self.kinds + 1))
        # Histories are the shorter n-grams and the openings.
        history = np.zeros(size, bool)
        for gram in (*held.gram[:-1], held.opening):
            history[gram] = True
        state = np.where(history, np.cumsum(history), 0)
        self.words, states = words, int(np.count_nonzero(history)) + 1
        # The empty state: an arc for each word.
        word = code[some[0][own]]
        self.root_weight, self.root_next = np.zeros(words), np.zeros(words, np.int64)
        self.root_weight[word], self.root_next[word] = np.log10(p[own]), np.where(c[own] > 0, state[own], 0)
        self.fail, self.fail_weight = np.zeros(states, np.int64), np.zeros(states)
        arcs, weights, nexts = [], [], []
        for n in range(2, self.order + 1):
            m = PRIOR[min(n - 2, len(PRIOR) - 1)]
            own = np.flatnonzero(some[n - 1] >= 0)
            place = some[n - 1][own]
            before = np.where(first[place], held.opening[n - 2], held.gram[n - 2][place - 1])
            shorter = held.gram[n - 2][place]
            p[own] = (c[own] + m * p[shorter]) / (c[before] + m)
            arc = c[own] > 0
            arcs.append(state[before[arc]] * words + code[place[arc]])
            weights.append(np.log10(p[own[arc]]))
            nexts.append(state[(own if n < self.order else shorter)[arc]])
            # The failure arcs of the histories of n - 1 words, the opening last.
            ended = np.flatnonzero(some[n - 2] >= 0)
            longer = np.append(ended, held.opening[n - 2])
            self.fail_weight[state[longer]] = np.log10(m / (c[longer] + m))
            if n > 2:
                self.fail[state[longer]] = state[np.append(held.gram[n - 3][some[n - 2][ended]], held.opening[n - 3])]
        key = np.concatenate(arcs) if arcs else np.zeros(0, np.int64)
        self.arcs = dict(zip(key.tolist(), range(len(key)), strict=True))
        self.weight = array("d", np.concatenate(weights).tobytes() if arcs else b"")
        self.next = array("q", np.concatenate(nexts).tobytes() if arcs else b"")
        self.start = int(state[held.opening[-1]]) if self.order > 1 and c[held.opening[-1]] > 0 else 0

    def traverse(self, held: Block) -> np.ndarray:
        """The log10 probability of each token, read from left to right with the state carried along."""
        arcs, weight, after, fail, lost = self.arcs, self.weight, self.next, self.fail.tolist(), self.fail_weight.tolist()
        root_weight, root_next, words = self.root_weight.tolist(), self.root_next.tolist(), self.words
        out = array("d")
        for a, b in zip(held.at[:-1].tolist(), held.at[1:].tolist(), strict=True):
            state = self.start
            for word in held.code[a:b].tolist():
                x = 0.0
                while state:
                    arc = arcs.get(state * words + word)
                    if arc is not None:
                        x += weight[arc]
                        state = after[arc]
                        break
                    x += lost[state]
                    state = fail[state]
                else:
                    x += root_weight[word]
                    state = root_next[word]
                out.append(x)
        return np.frombuffer(out) if out else np.zeros(0)

    def read(self, token: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its count, its log10 probability without a history, and that of the traversal."""
        own, code = np.unique(token, return_inverse=True)
        return self.score(Block(own, code, at, self.order))

    def score(self, held: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.build(held)
        count = self.count(held.kind)[held.gram[0]]
        return count, np.log10((count + 0.5) / (self.total + 0.5 * (self.kinds + 1))), self.traverse(held)


def _scored(order: int, shards: int, total: int, kinds: int):
    """Blocks with the answers to them (block, shard, data): a row for each text."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(_rows(batches)):
            own, code, at, ids, no_id, out = unpack(rows[0][2])
            held = Block(own, code, at, order)
            n = held.counted(out)
            edge = cuts(held.kind, shards)
            for _, shard, data in rows[1:]:
                bits, sums, large = unpack(data)
                sums = sums.astype(np.int64)
                sums[sums == 255] = large
                part = slice(edge[shard], edge[shard + 1])
                n[part][np.unpackbits(bits, count=edge[shard + 1] - edge[shard]).astype(bool)] = sums
            count, base, full = Automaton(held.kind, n, total, kinds, order).score(held)
            # A text has one token at least, its end.
            add = lambda x: np.add.reduceat(x, at[:-1])
            yield pa.record_batch(
                [pa.array(ids, mask=no_id), pa.array(out), pa.array(np.diff(at)), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(out), total)), pa.array(add(base)), pa.array(add(full))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return scored


def score_documents(docs: DataFrame, order: int = 2, fold: int = 1, folds: int = 5, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(doc_id as text) mod ``folds`` equal to ``fold`` are held out of training. ``order`` is the
    length of the longest n-grams, 1 or more. Texts are coded where they are read; with ``blocks`` they are first
    dealt to so many tasks, for a table in few large files.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    shards = shard_count(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if blocks:
        rows = rows.repartition(blocks)
    texts = written(rows.mapInArrow(_coded(fold, folds, block_bytes(docs.sparkSession, BLOCK_BYTES)), "block long, data binary"), "lm-texts")
    sent = texts.mapInArrow(_counted(order, shards), "shard int, block long, data binary")
    answers = written(dealt(sent, "block").mapInArrow(_answered, "block long, shard int, data binary"), "lm-answers")
    # One small row for each shard
    sums = [unpack(bytes(r[0]))[0] for r in answers.where("block is null").select("data").collect()]
    total, kinds = (int(sum(s[k] for s in sums)) for k in (0, 1))
    told = texts.select("block", F.lit(TEXTS).alias("shard"), "data").unionByName(answers.where("block is not null"))
    met = told.repartition("block").sortWithinPartitions("block", "shard")
    return met.mapInArrow(_scored(order, shards, total, kinds), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
