import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscan.llm import packing, sharding
from tests.llm import data

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN, ENCODER = Tokenizer.from_file(PATH), packing.Encoder(PATH)
BITS = ["a", "Zé", "ñ…", "'", "'ll", "\n", "\n\n", "\t", " ", "  ", ".", ",", ";", "|", "*", "&", "19", "　", "\x85", "ß", "日", " the", " of.", "<|endoftext|>", "\r\n", "×÷", "\x1c"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=25).map("".join), min_size=1, max_size=6))
def test_ids_are_those_of_whole_texts(texts):
    ids, at = ENCODER(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_tokenizer_of_another_rule_encodes_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain = packing.Encoder(path), Tokenizer.from_file(path)
    texts = [x or "" for x in data.texts()[:19]] + ["It's A,b  C\n\nnaïve 12", "<|endoftext|> x"]
    ids, at = own(pa.array([None, *texts]))
    assert ENCODER.divides and not own.divides
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [[], *(plain.encode(t, add_special_tokens=False).ids for t in texts)]


def test_forgetting_units_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "MOST_KNOWN", 5)
    own = packing.Encoder(PATH)
    for text in [x or "" for x in data.texts()[:19]] * 2:
        ids, _ = own(pa.array([text]))
        assert ids.tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_piece_lengths():
    for n in [1, 2, 3, 7, 8, 9, 100]:
        length, each = packing.piece_lengths(np.array([n]), 8)
        assert length.sum() == n and each[0] == len(length) and all(x & (x - 1) == 0 and x <= 8 for x in length.tolist())
        assert sorted(length.tolist(), reverse=True) == length.tolist()


@pytest.mark.parametrize("make", [data.documents, data.awkward, data.none])
def test_pieces_cover_every_id_once(spark, make):
    docs = make(spark)
    got = packing.pack_documents(docs, PATH, limit=64).collect()
    want = Counter((r["doc_id"], tuple([*PLAIN.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    assert len({r["sequence_id"] for r in got}) == len(got)
    whole = Counter()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["sequence_id"]):
        assert r["length"] == len(r["ids"]) == 1 << r["bucket"] and r["length"] <= 64 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        if r["start"] == 0 and by[r["doc_id"]]:
            whole[(r["doc_id"], tuple(by.pop(r["doc_id"])))] += 1
        assert r["start"] == len(by[r["doc_id"]])
        by[r["doc_id"]] += r["ids"]
    whole.update((d, tuple(v)) for d, v in by.items() if v)
    assert whole == want


def test_buckets_are_written_apart(spark, tmp_path):
    packing.write_buckets(packing.pack_documents(data.documents(spark), PATH, limit=64), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).groupBy("bucket", "length").count().count() == 7


def test_limit_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack_documents(data.documents(spark), PATH, limit=100)


@pytest.mark.parametrize("make", [data.documents, data.awkward, data.none])
def test_sharding(spark, make):
    docs = make(spark)
    got = sharding.assign(docs, sharding.topology(8), sharding.topology(9), buckets=5).collect()
    assert len(got) == docs.count()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes


def test_draws_against_brute_force(spark):
    """The descent from its definition: of each node's children the one with the smallest exponential variate."""
    tree = {0: {0: {0: 1.0, 1: 2.5}, 1: {2: 1.0}}, 1: {0: {3: 0.0, 4: 1.0, 5: 3.0}}}
    ids = [None, 0, -1, 2**63 - 1, -(2**63), *range(10, 400)]

    def weight(node):
        return sum(map(weight, node.values())) if isinstance(node, dict) else node

    def drawn(key, name, w):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        return -math.log(((xxhash.xxh64_intdigest(name.encode(), seed) >> 11) + 0.5) / 2**53) / w

    def descend(key, node, name=""):
        chosen = min((c for c in node if weight(node[c]) > 0), key=lambda c: drawn(key, f"{name}/{c}", weight(node[c])))
        return descend(key, node[chosen], f"{name}/{chosen}") if isinstance(node[chosen], dict) else chosen

    for nodes in (tree, sharding.topology(8), sharding.topology(9)):
        keys = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        got = keys.select("doc_id", sharding.shard_of(keys.doc_id, nodes).alias("s")).collect()
        assert {r["doc_id"]: r["s"] for r in got} == {i: descend(i, nodes) for i in ids}


def test_shares_follow_weights_and_moves_stay_in_changed_subtrees(spark):
    keys = spark.range(40_000).selectExpr("id as doc_id")
    place = lambda tree: [r[0] for r in keys.select(sharding.shard_of(keys.doc_id, tree)).collect()]
    eight, nine = place(sharding.topology(8)), place(sharding.topology(9))
    assert all(4600 < n < 5400 for n in Counter(eight).values())
    assert {b for a, b in zip(eight, nine) if a != b} == {8} and 3900 < Counter(nine)[8] < 5000
    tree = sharding.topology(8)
    heavy = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    heavy[0][0][0] = 3.0
    after = place(heavy)
    region = {s: r for r, racks in tree.items() for rack in racks.values() for s in rack}
    # Into the region that became heavier, never between or into others.
    assert all(region[b] == 0 for a, b in zip(eight, after) if a != b)
    assert 11_000 < Counter(after)[0] < 13_000
    assert sharding.topology(3) and sorted(s for racks in sharding.topology(11).values() for rack in racks.values() for s in rack) == list(range(11))


def test_shards_are_written(spark, tmp_path):
    sharding.write_shards(data.documents(spark), sharding.topology(8), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(data.rows())
