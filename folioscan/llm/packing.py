"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are powers of two, at most ``limit``: as many whole
limits as fit, then one piece for each binary digit of the rest, longest first. Each piece is a sequence of
its own, and sequences of one length form a bucket that is trained on together. No sequence crosses
documents and none needs padding.

Token ids come from a public tokenizer, whose path is a parameter. A batch's texts are cut where the
tokenizer's own splitting always begins a new piece; each distinct unit is encoded once and the ids are put together again, exactly as the whole text's. That is the byte-level rule with its own pattern; texts of a tokenizer that
normalises or splits otherwise are encoded whole.

Defined cases: null text counts as empty and yields the end id alone; rows that repeat are packed each;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.textblocks import blocks, column, starts_of, utf8, within

BLOCK_BYTES = 3 << 20
#: Units that a worker remembers between blocks.
MOST_KNOWN = 150_000
#: Fixed value: punctuation that begins a new piece behind a letter.
PUNCTUATION = ",.;:!?*#%&$"
#: First bytes of UTF-8 characters some of which are spaces; units are not cut before them.
MAYBE_SPACE = (0xC2, 0xE1, 0xE2, 0xE3)


def piece_lengths(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, number for each document): whole limits, then the binary digits of the rest."""
    bits = limit.bit_length() - 1
    whole, rest = tokens // limit, tokens % limit
    digits = (rest[:, None] >> np.arange(bits - 1, -1, -1)) & 1 == 1
    each = whole + digits.sum(1)
    out = np.full(int(each.sum()), limit, np.int64)
    doc, bit = np.nonzero(digits)
    first = starts_of(each)[:-1] + whole
    place = first[doc] + within(digits.sum(1))
    out[place] = limit >> (bit + 1)
    return out, each


def unit_cuts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the byte-level splitting rule surely begins a new piece, so that units can be encoded apart.

    That is before a space with a character behind it, between a letter and the punctuation that follows,
    and around a single line end between two printable ASCII characters.
    """
    printable = np.zeros(256, bool)
    printable[0x21:0x7F] = True
    solid = printable.copy()
    solid[0x80:] = True
    solid[list(MAYBE_SPACE)] = False
    letter = np.zeros(256, bool)
    letter[0x41:0x5B] = letter[0x61:0x7B] = True
    mark = np.zeros(256, bool)
    mark[[ord(c) for c in PUNCTUATION]] = True
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        left, right = raw[:-1], raw[1:]
        cut[:-2] |= (left == 0x20) & solid[right]
        after_letter = letter[left]
        # the second byte of a letter from U+00C0 to U+00FF
        latin = (left[1:] >= 0x80) & (left[1:] < 0xC0) & (left[:-1] == 0xC3) & (left[1:] != 0x97) & (left[1:] != 0xB7)
        after_letter[1:] |= latin
        cut[1:-1] |= after_letter & mark[right]
        line = (raw[1:-1] == 0x0A) & printable[raw[:-2]] & printable[raw[2:]]
        cut[1:-2] |= line
        cut[2:-1] |= line
    cut[ends[:-1][np.diff(ends) > 0]] = True
    return np.flatnonzero(cut[:-1])


def _byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary writes for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _divides(rules: dict) -> bool:
    """Whether a tokenizer, given as JSON, splits by the byte-level rule alone, so that units can be encoded apart."""
    split, model = rules.get("pre_tokenizer") or {}, rules["model"]
    bare = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token"))
    return not rules.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and model["type"] == "BPE" and bare


class Encoder:
    """Token ids of whole texts with a tokenizer file. Units met before are remembered, up to a fixed number."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.divides = _divides(json.loads(self.own.to_str()))
        self.model = self.own.model
        self.letters = _byte_letters()
        self.known: dict[str, int] = {}
        self.ids, self.at, self.forget = array("I"), array("q", [0]), []

    def _learn(self, names: list[str]) -> None:
        """Adds the ids of units that aren't known."""
        letters, tokenize, known, ids, at = self.letters, self.model.tokenize, self.known, self.ids, self.at
        mixed = []
        for name in names:
            bare = name[1:] if name[0] == " " else name
            if bare.isalpha() and max(bare) < "\u0250":  # one piece of the splitting rule: merges alone decide
                spelt = name if name.isascii() and name[0] != " " else "\u0120" + bare if name.isascii() else "".join([letters[b] for b in name.encode()])
                ids.extend([t.id for t in tokenize(spelt)])
                known[name] = len(at) - 1
                at.append(len(ids))
            else:
                mixed.append(name)
        for k in range(0, len(mixed), 5000):
            part = mixed[k : k + 5000]
            for name, x in zip(part, self.own.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids.extend(x.ids)
                known[name] = len(at) - 1
                at.append(len(ids))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's begin)."""
        if not self.divides:
            found = [x.ids for x in self.own.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.int64), starts_of(np.array([len(x) for x in found], np.int64))
        raw, ends = utf8(texts)
        begin = unit_cuts(raw, ends)
        place = np.searchsorted(begin, ends)
        units = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = units.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        names = coded.dictionary.to_pylist()
        if len(self.known) > MOST_KNOWN:  # what came first is kept: frequent units come early
            for name in itertools.islice(reversed(self.known), len(self.known) - MOST_KNOWN):
                self.forget.append(name)
            for name in self.forget:
                del self.known[name]
            self.forget.clear()
            del self.at[MOST_KNOWN + 1 :]
            del self.ids[self.at[-1] :]
        known = self.known
        self._learn([n for n in names if n not in known])
        unit = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[code]
        at = np.array(self.at)
        each = np.diff(at)[unit]
        ids = np.array(self.ids)[np.repeat(at[unit], each) + within(each)]
        return ids, starts_of(each)[place]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def _packed(path: str, limit: int, end_id: int, with_ids: bool):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for table in blocks(batches, BLOCK_BYTES):
            texts, doc_id = column(table, "text"), column(table, "doc_id")
            ids, at = encode(texts)
            tokens = np.diff(at) + 1
            whole = np.full(len(ids) + len(tokens), end_id, np.uint32)
            of = np.repeat(np.arange(len(tokens)), np.diff(at))
            whole[np.arange(len(ids)) + of] = ids
            length, each = piece_lengths(tokens, limit)
            doc = np.repeat(np.arange(len(tokens)), each)
            first = starts_of(length)
            start = first[:-1] - starts_of(tokens)[:-1][doc]
            little = whole.astype("<u4").tobytes()
            crc = [zlib.crc32(little[4 * a : 4 * b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            out = [doc_id.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[doc])]
            if with_ids:
                out.append(pa.LargeListArray.from_arrays(pa.array(first), pa.array(whole.astype(np.int32))).cast(pa.list_(pa.int32())))
            result = pa.record_batch(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(out)])
            for k in range(0, result.num_rows, 20_000):
                yield result.slice(k, 20_000)

    return packed


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (if asked for), sequence_id, offset, bucket.

    ``bucket`` is the length's exponent; a sequence is one piece, so ``offset`` is 0. ``sequence_id`` is
    unique and, for given input files, the same in every run.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit is a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed(tokenizer, limit, end_id, with_ids), schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as Parquet with a folder for each length, to be read as batches of equal sequences."""
    pieces.write.partitionBy("bucket").parquet(path)
