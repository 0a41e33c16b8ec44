import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm import decontaminate, lm, quality, queries
from tests.llm import data

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_scores(rows, order, prior):
    """The model from its formulas, with plain dictionaries."""
    texts = [(d, [*data.PATTERN.findall((t or "").translate(FOLD)), None]) for d, t in rows]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts, begins = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for d, own in texts:
        if out(d):
            continue
        for i in range(len(own)):
            padded = ["<>"] * (order - 1) + own
            for n in range(1, order + 1):
                counts[n - 1][tuple(padded[i + order - n : i + order])] += 1
        for n in range(2, order + 1):
            begins[n - 1][("<>",) * (n - 1)] += 1
    total, kinds = sum(counts[0].values()), len(counts[0])

    def p(padded, end, n):
        gram = tuple(padded[end - n : end])
        if n == 1:
            return (counts[0][gram] + 0.5) / (total + 0.5 * (kinds + 1))
        h = gram[:-1]
        history = begins[n - 1][h] if set(h) == {"<>"} else counts[n - 2][h]
        return (counts[n - 1][gram] + prior[n - 2] * p(padded, end, n - 1)) / (history + prior[n - 2])

    result = []
    for d, own in texts:
        padded = ["<>"] * (order - 1) + own
        ends = range(order, len(padded) + 1)
        base = sum(math.log10(p(padded, e, 1)) for e in ends)
        result.append((d, out(d), len(own), sum(counts[0][(w,)] > 0 for w in own), total, base, sum(math.log10(p(padded, e, order)) for e in ends)))
    return result


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("make", [data.documents, data.awkward])
def test_scores_follow_the_formulas(spark, order, make):
    docs = make(spark)
    got = sorted(map(tuple, lm.score_documents(docs, order, blocks=3).collect()), key=str)
    want = sorted(brute_scores([(r["doc_id"], r["text"]) for r in docs.collect()], order, lm.PRIOR), key=str)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))), sorted(want, key=lambda r: (str(r[0]), r[2], r[3], round(r[5], 6)))):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)
    assert len(got) == len(want)


def test_arcs_of_a_state_add_up_to_one():
    token = np.array([1, 2, 1, 3, 1, 2, lm.END], np.uint64)
    at = np.array([0, 7])
    keys = np.concatenate([*lm.ngrams(token, at, 2), np.array([lm.BEGIN ^ np.uint64(2)])])
    kind, n = np.unique(keys, return_counts=True)
    model = lm.Automaton(kind, n, 7, 4, 2)
    for history in (1, 2, 3, 9):
        total = 0.0
        for word in (1, 2, 3, int(lm.END), 77):  # 77 stands for every unknown word
            _, _, p = model.read(np.array([history, word], np.uint64), np.array([0, 2]))
            total += 10 ** p[1]
        assert total == pytest.approx(1)


def test_no_documents_and_no_training(spark):
    assert lm.score_documents(data.none(spark)).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    one = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert one["train_tokens"] == 0 and one["n_known"] == 0 and one["held_out"] and math.isfinite(one["score"])


GAP = __import__("re").compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, window=8):
    kinds = {}
    for item, text in items:
        own = GAP.findall((text or "").translate(FOLD))
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            kinds.setdefault(tuple(own[i : i + size]), set()).add(item)
    out = []
    for d, text in docs:
        own = GAP.findall((text or "").translate(FOLD))
        hit, met = set(), set()
        for i in range(len(own)):
            for size in {len(k) for k in kinds}:
                found = kinds.get(tuple(own[i : i + size])) if i + size <= len(own) else None
                if found:
                    hit |= set(range(i, i + size))
                    met |= found
        out.append((d, len(own), len(hit), len(met)))
    return out


ITEMS = [(1, " ".join(data.words(40, 2))), (2, " ".join(data.words(120, 1)[30:50])), (3, "four five"), (4, "two, THREE four"), (5, ""), (6, None), (7, "naïve — ñandú 日本語のテキスト"), (8, "ha ha ha ha ha ha ha ha ha"), (9, "ho hum ho hum ho hum ho"), (10, "zz yy"), (1, " ".join(data.words(40, 2))), (None, "one")]


@pytest.mark.parametrize("k,broadcast", [(5, 500_000), (8, 500_000), (2, 500_000), (5, 3)])
def test_decontamination_is_exact(spark, k, broadcast):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = data.documents(spark)
    got = decontaminate.hits(docs, items, 8, k, broadcast).select("doc_id", "n_words", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["length"] - 1))))).alias("h"), F.size("items").alias("i")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_hits([(r[0], r[1]) for r in data.rows()], [x for x in ITEMS if x[0] is not None]))


def test_decontamination_of_awkward_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = data.awkward(spark)
    got = decontaminate.decontaminate(docs, items)
    assert got.count() == docs.select("doc_id", "text").distinct().count()
    assert decontaminate.decontaminate(data.none(spark), items).count() == 0
    nothing = decontaminate.decontaminate(docs, items.limit(0)).collect()
    assert all(r["n_hit"] == 0 and r["n_items"] == 0 for r in nothing)
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert Counter(clean.select("text").toPandas()["text"].tolist()) == Counter(t for (t,) in docs.select("text").collect() if brute_hits([(0, t)], [x for x in ITEMS if x[0] is not None])[0][3] == 0)


def test_decontamination_query_keeps_repeated_rows(spark, tmp_path):
    docs = data.awkward(spark).select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.QUERIES["op8_decontaminate"](spark, str(tmp_path)).select("doc_id", "n_words", "n_hit", "n_items").collect()
    assert Counter(map(tuple, got)) == Counter(brute_hits([tuple(r) for r in docs.collect()], [x for x in ITEMS if x[0] is not None]))


def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        own = data.words(20 + i % 90, 5000 + i)
        kind = i % 4
        if kind == 1:
            own[i % len(own)] = own[-1] = "nasty"
        if kind == 2:
            own = [w + "&&&" if k % 2 else "|" for k, w in enumerate(own)]
        rows.append((i, " ".join(own)))
        labels.append((i, int(kind != 2), int(kind == 1)))
    return rows, labels


def test_the_classifier_orders_grades_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.quality(docs, spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 602
    held = [got[i] for i in range(400, 600)]
    assert np.mean([r["kept"] == (r["doc_id"] % 4 in (0, 3)) for r in held]) > 0.95
    assert all(0 <= r["p_clean"] <= r["p_good"] <= 1 and r["expected_grade"] == pytest.approx(r["p_clean"] + r["p_good"]) for r in got.values())
    assert got[1000]["score"] == got[1001]["score"] == 0


def test_the_gradient_is_that_of_the_likelihood():
    """Each slope against a central difference of the loss, at random points."""
    r = np.random.default_rng(3)
    grade = r.integers(0, 3, 40)
    row, column = r.integers(0, 40, 200), r.integers(0, 6, 200)
    value = r.random(200)
    for _ in range(5):
        at = [r.normal(size=6), r.normal(size=1), r.normal(size=1)]
        _, slopes = quality.likelihood(*at, row, column, value, grade)
        for which, own in enumerate(at):
            for k in range(len(own)):
                losses = []
                for step in (1e-6, -1e-6):
                    moved = [x.copy() for x in at]
                    moved[which][k] += step
                    losses.append(quality.likelihood(*moved, row, column, value, grade)[0])
                assert slopes[which][k] == pytest.approx((losses[0] - losses[1]) / 2e-6, rel=1e-4, abs=1e-8)


def test_the_fit_separates_grades():
    grade = np.repeat([0, 1, 2], 60)
    at = np.arange(181)
    model = quality.fit(at, grade.astype(np.int32), np.ones(180, np.float32), grade)
    tails = model.tails(model.score(at, grade.astype(np.int32), np.ones(180, np.float32)))
    assert model.thresholds[0] < model.thresholds[1]
    assert ((tails >= 0.5).sum(1) == grade).all()


def test_a_score_does_not_depend_on_the_rows_beside_it():
    r = np.random.default_rng(4)
    sizes = r.integers(0, 300, 500)
    at = np.concatenate([[0], np.cumsum(sizes)])
    feature, value = r.integers(0, quality.FEATURES, at[-1]).astype(np.int32), r.random(at[-1]).astype(np.float32)
    model = quality.Ordinal(r.normal(size=quality.FEATURES).astype(np.float32), np.array([0.0, 1.0]))
    whole = model.score(at, feature, value)
    for i in range(500):
        own = slice(at[i], at[i + 1])
        assert model.score(np.array([0, sizes[i]]), feature[own], value[own])[0] == whole[i]
        assert whole[i] == pytest.approx(math.fsum(float(w) * float(v) for w, v in zip(model.weights[feature[own]], value[own])), abs=1e-9)


def test_labels_without_a_document_take_no_place(spark):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    strangers = spark.range(10_000, 40_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    alone, beside = quality.train(docs, own, 300), quality.train(docs, own.unionByName(strangers), 300)
    assert (alone.weights == beside.weights).all() and (alone.thresholds == beside.thresholds).all()


def test_labels_of_one_kind_none_and_awkward_rows(spark):
    docs = data.awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, none).collect()
    assert len(got) == docs.count() and all(r["kept"] for r in got)
    odd = spark.createDataFrame([(13, None, None), (13, 0, 1), (None, 1, 0), (99999, 1, 0), (16, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.kept_documents(docs, odd)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert quality.quality(data.none(spark), odd).count() == 0


def test_each_stage_against_brute_force(spark, tmp_path):
    """Every stage but the classifier on its own input: copies, near copies, leaks and token sequences by their definitions."""
    from tests.llm.test_dedup import brute_components
    from tests.llm.test_packing_sharding import PLAIN

    frame = data.documents(spark)
    spark.createDataFrame([(13, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([i for i in ITEMS if len((i[1] or "").split()) > 7], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    items = [i for i in ITEMS if i[0] is not None and len((i[1] or "").split()) > 7]
    docs, sizes = frame, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if name != "quality_classifier" else None
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        got = {r["doc_id"] for r in after}
        if name == "exact_duplicates":
            assert got == {max(d for d, t in before.items() if (t or "") == text) for text in {t or "" for t in before.values()}}
        elif name == "near_duplicates":
            near = brute_components(list(before.items()), 5, 80)
            assert got == {c for _, c in near.values()}
        elif name == "benchmark_leaks":
            assert got == {d for d, _, _, met in brute_hits(list(before.items()), items) if met == 0}
        elif name == "packed":
            pieces = {}
            for r in sorted(after, key=lambda r: (r["doc_id"], r["start"])):
                assert r["length"] & (r["length"] - 1) == 0 and r["start"] == sum(n for n, _ in pieces.get(r["doc_id"], []))
                pieces.setdefault(r["doc_id"], []).append((r["length"], r["ids_crc32"]))
            for d, text in before.items():
                ids, at = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1], 0
                for n, crc in pieces.pop(d):
                    assert crc == zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
                    at += n
                assert at == len(ids)
            assert not pieces
        sizes.append(len(got))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]


def test_the_pipeline_keeps_what_each_stage_keeps(spark, tmp_path):
    base = data.words(300, 41, 2000)
    rows, labels = labelled(spark)
    leak = " ".join(data.words(20, 77, 9000))
    rows += [(2000, " ".join(base)), (2001, " ".join(base)), (2002, " ".join(data.edited(base, 100, 4))), (2003, " ".join(data.words(50, 78, 900)) + " " + leak), (2004, None)]
    frame = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = frame, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == frame.columns
        kept.append({r[0] for r in docs.select("doc_id").distinct().collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:]))
    assert {2000, 2001, 2002, 2003, 2004} <= kept[0]
    assert kept[1] & {2000, 2001} == {2001} and kept[2] & {2001, 2002} == {2001} and 2003 in kept[2] and 2003 not in kept[3] and kept[4] == kept[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in whole.select("doc_id").distinct().collect()} == kept[4]
