import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from folioscan.llm import exact_dedup, exchange, ngram_join, substring_dedup
from tests.llm import data


def brute_substring(rows, w=20):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        own = data.PATTERN.findall(text or "")
        gone = [False] * len(own)
        for p in range(len(own) - w + 1):
            k = tuple(own[p : p + w])
            if k in seen:
                gone[p : p + w] = [True] * w
            seen.add(k)
        kept = " ".join(x for x, g in zip(own, gone) if not g)
        out[doc_id] = (len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("k,block", [(8, 6 << 20), (8, 2000), (3, 500), (20, 6 << 20)])
def test_substring_dedup_is_exact(spark, monkeypatch, k, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    got = substring_dedup.substring_dedup(data.documents(spark), k=k).collect()
    want = brute_substring([(r[0], r[1]) for r in data.rows()])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert sum(r["n_removed"] for r in got) > 300


def test_substring_dedup_of_awkward_rows(spark):
    got = substring_dedup.substring_dedup(data.awkward(spark)).collect()
    assert len(got) == data.awkward(spark).count()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_words"], r["n_removed"], r["kept_sha256"]))
    assert len(by[13]) == 1, "repeated rows are one place and share a result"
    assert substring_dedup.substring_dedup(data.none(spark)).count() == 0


@pytest.mark.parametrize("block", [6 << 20, 500])
def test_substring_dedup_tells_rows_apart_by_id_and_text(spark, monkeypatch, block):
    """Rows are ordered by id (null first), then by hash of their text; a repeated row is the place of the first."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    passage, other = data.words(60, 300), data.words(30, 303)
    more = [
        (900, " ".join(passage)), (900, "short text of the same id"), (900, " ".join(data.words(25, 301) + passage)), (901, " ".join(data.words(90, 302))),
        (None, " ".join(data.words(7, 304) + other)), (None, " ".join(data.words(9, 305) + other)), (None, " ".join(data.words(7, 306) + other)), (None, "a few words"),
    ]
    pairs = data.awkward(spark).select("doc_id", "text")
    docs = pairs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)
    rows = [(substring_dedup.NO_ID if i is None else i, h, t) for i, t, h in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()]
    want = brute_substring([((i, h), t) for i, h, t in set(rows)])
    got = substring_dedup.substring_dedup(docs).collect()
    found = Counter((substring_dedup.NO_ID if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)
    assert found == Counter((i, *want[i, h]) for i, h, _ in rows)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_substring_dedup_settles_a_hot_passage_in_its_block(spark):
    passage = " ".join(data.words(40, 99))
    docs = spark.createDataFrame([(i, f"u{i} {passage} v{i}") for i in range(300)], "doc_id long, text string")
    got = substring_dedup.substring_dedup(docs).collect()
    assert Counter(r["n_removed"] for r in got) == {40: 299, 0: 1}


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, keep):
    for make in (data.documents, data.awkward):
        docs = make(spark)
        groups = defaultdict(list)
        for r in docs.collect():
            groups[r["text"] or ""].append(r["doc_id"])
        got = exact_dedup.exact_dedup(docs, keep).collect()
        assert len(got) == docs.count()
        for r in got:
            own = next(ids for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
            real = [x for x in own if x is not None]
            stays = (max(real) if keep == "max" else min(real)) if real else None
            assert (r["keep_id"], r["group_size"], r["kept"]) == (stays, len(own), r["doc_id"] == stays)
    assert exact_dedup.exact_dedup(data.none(spark)).count() == 0


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_at_the_ends_of_the_ids(spark, keep):
    ids = [2**63 - 1, -(2**63), 0, -1, None, None]
    docs = spark.createDataFrame([(i, "same") for i in ids] + [(None, "alone"), (-(2**63), "other")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, keep).collect())
    stays = 2**63 - 1 if keep == "max" else -(2**63)
    assert got == Counter([*((i, stays, 6, i == stays) for i in ids), (None, None, 1, True), (-(2**63), -(2**63), 1, True)])
    assert Counter(map(tuple, exact_dedup.kept_documents(docs, keep).collect())) == Counter([(stays, "same"), (None, "alone"), (-(2**63), "other")])


@pytest.mark.parametrize("rounds", [0, 1, 4, 6])
def test_any_number_of_rounds_agrees(spark, rounds):
    got = exact_dedup.exact_dedup(data.documents(spark), rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, exact_dedup.exact_dedup(data.documents(spark)).collect()), key=str)


def test_kept_documents_are_one_for_each_text_with_all_columns(spark):
    docs = data.awkward(spark)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(r["text"] or "" for r in rows) == Counter({t or "" for (t,) in docs.select("text").collect()})


def shingles(text, n):
    own = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in data.PATTERN.findall(text or "")]
    return {tuple(own[i : i + n]) for i in range(max(len(own) - n + 1, 1))} if own else set()


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("n,percent,block", [(4, 85, 6 << 20), (5, 80, 3000), (2, 60, 6 << 20)])
def test_ngram_join_is_exact(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
    got = ngram_join.linked_components(data.documents(spark), n, percent).collect()
    want = brute_components([(r[0], r[1]) for r in data.rows()], n, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 8


def test_ngram_join_finds_links_at_the_edge(spark):
    """Families whose members lie around the threshold, so that trees and not only first partners are needed."""
    rows, k = [], 0
    for family in range(12):
        base = data.words(200, 500 + family, 3000)
        for member in range(9):
            rows.append((k, " ".join(data.edited(base, 40 + 9 * member, 1000 * family + member))))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked_components(docs).collect()}
    assert got == brute_components(rows, 4, 85)


def test_ngram_join_of_awkward_rows(spark):
    docs = data.awkward(spark)
    got = ngram_join.linked_components(docs).collect()
    assert len(got) == docs.count()
    assert ngram_join.linked_components(data.none(spark)).count() == 0
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    assert {r["text"] for r in kept.collect()} >= {"", None, "one", "only here"}


@pytest.mark.parametrize("most", [2, 5])
def test_parts_of_a_route_lose_no_link(spark, monkeypatch, most):
    """The same as whole trees: 60 texts that all share a long passage, in families around the threshold."""
    monkeypatch.setattr(ngram_join, "MOST_IN_TREE", most)
    common, rows = data.words(60, 900), []
    for k in range(60):
        base = data.words(140, 910 + k // 6, 3000)
        rows.append((k, " ".join(common + data.edited(base, 30 + 11 * (k % 6), k))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked_components(docs).collect()}
    assert got == brute_components(rows, 4, 85)


def test_documents_without_an_id_link_others(spark):
    """1 and 2 are not near enough to each other, but both are to a text without an id, which stands there twice."""
    base = data.words(300, 77, 5000)
    left, right = list(base), list(base)
    left[40:49], right[240:249] = data.words(9, 78, 9), data.words(9, 79, 9)
    rows = [(1, " ".join(left)), (2, " ".join(right)), (None, " ".join(base)), (None, " ".join(base)), (None, "quite another text"), (7, "one more text here"), (7, " ".join(right))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {t: k for k, t in enumerate(dict.fromkeys(t for _, t in rows))}
    brute = brute_components([(k, t) for t, k in ids.items()], 4, 90)
    assert brute[0][1] == brute[1][1] == brute[2][1] == 0 and brute_components([(1, rows[0][1]), (2, rows[1][1])], 4, 90)[2][1] == 2
    got = ngram_join.linked_components(docs, percent=90).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([(1, 1), (2, 1), (None, 1), (None, 1), (None, None), (7, 7), (7, 1)])
    kept = ngram_join.representatives(docs, 4, 90).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([1, None, None, None, 7]) and (7, "one more text here") in map(tuple, kept)


def test_sets_of_one_number_differ_in_their_check(monkeypatch):
    own = ngram_join.set_ids
    monkeypatch.setattr(ngram_join, "set_ids", lambda hashes, at, *seed: own(hashes, at, *seed) if seed else np.full(len(at) - 1, 5, np.uint64))
    table = pa.table({"doc_id": [1, 2, 3], "text": ["a b c d e", "f g h i j", "a b c d e"], "text_sha": [10, 20, 10]})
    blobs = [exchange.unpack(x) for b in ngram_join._routes(4, 85, 2)(iter(table.to_batches())) for x in b.column(1).to_pylist()]
    (members,) = [m for m in blobs if m[0].dtype == np.int8 and m[0][0] == 0]
    assert (members[1] == 5).all() and members[6][0] == members[6][2] != members[6][1]


@pytest.mark.parametrize("leaf,step", [(32, 1 << 14), (4, 50)])
def test_count_tree_drops_only_what_its_bound_rules_out(monkeypatch, leaf, step):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "STEP", step)
    count = 150
    r = np.random.default_rng(1)
    vectors = r.poisson(3, (count, 64)).astype(np.int32)
    vectors[50:60] = vectors[40:50]
    vectors[55:60, :4] += 1
    size, apart = vectors.sum(1), np.arange(150)
    tree = ngram_join.CountTree(vectors, size)
    found = [(min(a, b), max(a, b)) for i, j, _ in tree.survivors(85, apart) for a, b in zip(i.tolist(), j.tolist())]
    got = set(found)
    assert len(got) == len(found)
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if min(size[a], size[b]) * 100 >= 85 * max(size[a], size[b]) and np.minimum(vectors[a], vectors[b]).sum() >= ngram_join.needed(int(size[a]), int(size[b]), 85)}
    near = ngram_join.nearest(tree, 85, apart)
    assert all((near[k] >= 0) == any(k in p for p in want) for k in range(150)) and all((min(k, n), max(k, n)) in want for k, n in enumerate(near.tolist()) if n >= 0)
    assert got == want and {(40 + k, 50 + k) for k in range(10)} <= got


def test_shared_routes_bound_holds():
    r = np.random.default_rng(2)
    for _ in range(300):
        n = int(r.integers(3, 120))
        a = set(r.choice(10**6, n, replace=False).tolist())
        b = set(list(a)[: n - int(r.integers(0, max(1, n // 8)))]) | set((10**6 + r.choice(10**6, int(r.integers(0, max(1, n // 8))), replace=False)).tolist())
        if not b or 100 * len(a & b) < 85 * len(a | b):
            continue
        mixed = lambda s: sorted((x * 2654435761) % 2**32 for x in s)[: len(s) - -(-85 * len(s) // 100) + 1]
        assert len(set(mixed(a)) & set(mixed(b))) >= ngram_join.shared_routes(len(a), len(b), 85)
