import json

import pytest
from pyspark.sql import functions as F

from folioscan.operators import chunking, evaluation, grounding as G, hygiene, index, ingest, profiles, search
from folioscan.sources import files, models


def section(texts):
    return [{"pdf_page": k + 1, "book_page": 42 + k, "text": t} for k, t in enumerate(texts)]


def size(chunk, path="Path"):
    return chunking.tokens(path + "\n\n" + "\n\n".join(p["text"] for p in chunk))


def test_headings_cut_and_pages_are_kept():
    pages = section(["CROSSING\n" + "walk on. " * 20, "RESTING\n" + "sleep now. " * 20])
    chunks = chunking.split_section(pages, "Path", 90)
    assert [[p["book_page"] for p in c] for c in chunks] == [[42], [43]] and all(size(c) <= 90 for c in chunks)


def test_whole_units_overlap():
    lines = [f"This is sentence number {k} of a long list of them." for k in range(40)]
    chunks = chunking.split_section(section(["\n".join(lines)]), "Path", 90)
    assert len(chunks) > 3 and all(size(c) <= 90 for c in chunks)
    split = [c[0]["text"].split("\n") for c in chunks]
    assert all(a[-1] == b[0] for a, b in zip(split, split[1:]))
    assert {x for s in split for x in s} == set(lines)


def test_nothing_is_cut_inside():
    with pytest.raises(chunking.Indivisible):
        chunking.split_section(section(["x" * 1000]), "Path", 50)
    with pytest.raises(ValueError):
        chunking.split_section(section(["x"]), "p" * 400, 50)
    assert chunking.split_section(section(["short"]), "Path", 50) == [section(["short"])]


def test_a_paragraph_is_kept_above_the_overlap_target():
    body = "\n\n".join("a" * 109 for _ in range(8))
    chunks = chunking.split_section(section([body]), "Path", 100)
    assert len(chunks) > 1 and all(size(c) <= 100 for c in chunks)
    assert all(a[0]["text"].split("\n\n")[-1] == b[0]["text"].split("\n\n")[0] for a, b in zip(chunks, chunks[1:]))


def test_chunks_of_many_sections(spark):
    rows = [("b", k, "P", [(1, 42, "word. " * 30 * k), (2, None, "HEAD\nmore. " * 20)]) for k in range(6)] + [("b", 9, "P", [(1, 42, "x" * 9000)])]
    df = spark.createDataFrame(rows, f"book_id string, section_no long, section_path string, pages {chunking.PAGES}")
    got = chunking.section_chunks(df, 120).collect()
    assert [r["section_no"] for r in got if r["error"]] == [9]
    assert {r["section_no"] for r in got} == {0, 1, 2, 3, 4, 5, 9}


def test_a_worker_holds_few_chunks(spark):
    """A batch used to become one frame of all its chunks."""
    rows = [("b", k, "P", [{"pdf_page": 1, "book_page": None, "text": "All is well. " * 8000}]) for k in range(30)]
    made = chunking.section_chunks(spark.createDataFrame(rows, f"book_id string, section_no long, section_path string, pages {chunking.PAGES}").coalesce(1))
    sizes = made.mapInArrow(lambda batches: (b.select(["section_no"]) for b in batches if b.nbytes < 4 << 20), "section_no long")
    assert sizes.distinct().count() == made.select("section_no").distinct().count() == 30


def test_terms_are_counted_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "b a B c a b"), (2, ""), (3, "één 1 één")], "id long, text string")
    got = index.postings(docs, "id")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 6, 2), (1, "b", 6, 3), (1, "c", 6, 1), (3, "1", 3, 1), (3, "één", 3, 2)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_scores_of_a_document_are_added_where_it_is(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "dog")], "id long, text string")
    questions = spark.createDataFrame([(7, "red hen?")], "query_id long, question string")
    terms = search.question_terms(questions).select("term").distinct()
    own, all_ = (search.bm25(questions, index.impacts(docs, "id", terms=t), "id") for t in (terms, None))
    assert own.select("id", "score").collect() == all_.select("id", "score").collect() and [r["id"] for r in own.collect()] == [2, 1]
    assert "hashpartitioning(query_id" not in own._jdf.queryExecution().executedPlan().toString().split("WindowGroupLimit")[-1]


def test_greedy_pack(spark):
    df = spark.createDataFrame([([3, 3, 5, 9, 1],), ([],), ([20],)], "s array<long>")
    got = [[tuple(g) for g in r[0]] for r in df.select(chunking.greedy_pack(F.col("s"), 10)).collect()]
    assert got == [[(0, 1, 6), (2, 2, 5), (3, 4, 10)], [], [(0, 0, 20)]]


LINES = "book_id string, pdf_index long, line_no int, text string, x0 double, top double, bottom double, width double, height double"


def demo(spark, starts=(0, 1, 2, 3)):
    titles = ["Marsh road", "Bridge of mist", "Camp", "Night watch"]
    rows = []
    for i, t in enumerate(titles):
        body = [(100.0, t if i in starts else "plain"), (120.0, f"Rules of {t.lower()} here."), (300.0, "Second paragraph.")]
        rows += [("b", i, k, x, 60.0, y, y + 10, 595.0, 842.0) for k, (y, x) in enumerate([*body, (800.0, str(41 + i))])]
    lines = spark.createDataFrame(rows, LINES)
    order = [("Book", 1, 0)] + [(titles[i], 2, i) for i in starts]
    outline = spark.createDataFrame([("b", k, t, level, p) for k, (t, level, p) in enumerate(order)], "book_id string, ord long, title string, level int, pdf_index long")
    counts = spark.createDataFrame([("b", 4)], "book_id string, page_count long")
    digest = spark.createDataFrame([("b", "f" * 64)], "book_id string, file_sha256 string")
    return lines, outline, counts, digest


def test_ingestion_of_a_small_book(spark):
    got = ingest.ingest(*demo(spark)).orderBy("pdf_page").collect()
    assert [(r["section_path"], r["pdf_page"], r["book_page"]) for r in got] == [("Book > Marsh road", 1, 41), ("Book > Bridge of mist", 2, 42), ("Book > Camp", 3, 43), ("Book > Night watch", 4, 44)]
    assert all("Rules of" in r["raw_text"] and str(r["book_page"]) not in r["raw_text"] and r["text"].startswith(r["section_path"]) for r in got)
    assert len({r["id"] for r in got}) == 4 and all(len(r["id"]) == 64 for r in got)


def test_sections_over_several_pages_and_profiles(spark):
    lines, outline, counts, digest = demo(spark, (0, 1, 3))
    got = {r["section_path"]: r for r in ingest.ingest(lines, outline, counts, digest).collect()}
    assert [p["book_page"] for p in got["Book > Bridge of mist"]["pages"]] == [42, 43]
    dropped = spark.createDataFrame([("b", "BRIDGE  of mist")], "book_id string, title string")
    tables = spark.createDataFrame([("b", [8])], "book_id string, pages array<int>")
    offsets = spark.createDataFrame([("b", -7)], "book_id string, page_offset int")
    own = {r["section_path"]: r for r in ingest.ingest(lines, outline, counts, digest, dropped=dropped, table_pages=tables, offsets=offsets, regexes=["^Second"]).collect()}
    assert set(own) == {"Book > Marsh road", "Book > Night watch"}, "a dropped section still ends the one before it"
    assert own["Book > Night watch"]["book_page"] == 10 and own["Book > Marsh road"]["book_page"] == 7
    assert "Second" not in own["Book > Marsh road"]["raw_text"] and own["Book > Marsh road"]["type"] == "text"


def test_headings_that_repeat_or_are_missing(spark):
    from folioscan.operators import outline as O

    lines, outline, counts, _ = demo(spark)
    twice = lines.union(lines.where("text = 'Camp'").withColumn("line_no", F.lit(9)))
    own = {r["title"]: r for r in O.anchors(O.section_paths(outline), twice).collect()}
    assert own["Camp"]["problem"] == "ambiguous" and own["Bridge of mist"]["problem"] is None and not own["Book"]["found"]
    choice = spark.createDataFrame([("b", "camp", "Camp", 2)], "book_id string, title_key string, text string, occurrence int")
    chosen = {r["title"]: r for r in O.anchors(O.section_paths(outline), twice, choice).collect()}
    assert (chosen["Camp"]["line_no"], chosen["Camp"]["problem"]) == (9, None)
    bad = ingest.preconditions(outline.union(spark.createDataFrame([("b", 9, "x", 4, 77)], outline.schema)), counts).collect()
    assert {r["problem"] for r in bad} == {"a destination is outside the book", "a level is skipped"}


def test_statistics(spark):
    got = ingest.chunk_stats(ingest.ingest(*demo(spark))).first()
    assert got["chunks"] == got["sections"] == 4 == got["le_300"] and got["gt_1200"] == 0


def test_chunks_round_trip(spark, tmp_path):
    chunks = ingest.ingest(*demo(spark))
    files.write_chunks(chunks, str(tmp_path / "c"))
    back = files.read_chunks(spark, str(tmp_path / "c"))
    assert back.schema.simpleString() == chunks.schema.simpleString() and {r["id"] for r in back.collect()} == {r["id"] for r in chunks.collect()}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"id": 3, "pages": "no"}\n')
    with pytest.raises(Exception):
        files.read_chunks(spark, str(tmp_path / "bad")).collect()


def test_fusion(spark):
    rows = [(0, "bm25", "a", 1), (0, "bm25", "b", 2), (0, "dense", "c", 1), (0, "dense", "b", 2), (0, "dense", "b", 5)]
    got = {r["chunk_id"]: r for r in search.fuse(spark.createDataFrame(rows, "query_id long, branch string, chunk_id string, rank int")).collect()}
    assert got["b"]["rrf"] == pytest.approx(2 / 62) and got["a"]["dense_rank"] is None and max(got, key=lambda k: got[k]["rrf"]) == "b"


def scored(spark, rows):
    return spark.createDataFrame([(0, "b", p, f"c{k}", s, 0.01, k, 0) for k, (p, s) in enumerate(rows)], "query_id long, book_id string, pdf_page int, chunk_id string, score double, rrf double, place int, page_no int")


def test_admission_is_by_question_and_pages_are_distinct(spark):
    rows = scored(spark, [(1, 0.95), (2, 0.02), (3, 0.02), (4, 0.02), (1, 0.5)])
    assert [r["pdf_page"] for r in search.distinct_pages(search.admitted(rows, 0.5)).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert search.admitted(rows, 0.99).count() == 0 and search.distinct_pages(rows, 1).count() == 1
    with pytest.raises(ValueError):
        search.check_arguments(1.5)
    with pytest.raises(Exception, match="outside"):
        search.checked_scores(scored(spark, [(1, 1.5)])).collect()
    with pytest.raises(Exception, match="blank"):
        search.checked_questions(spark.createDataFrame([(0, "  ")], "query_id long, question string")).collect()


def test_search_end_to_end_and_index_reuse(spark, tmp_path):
    chunks = ingest.ingest(*demo(spark)).cache()
    fake = models.embedder(lambda: lambda texts: [[float("mist" in t.lower()), 1.0] for t in texts])
    vectors = chunks.select(F.col("id").alias("chunk_id"), fake("text").alias("vector"))
    folder = index.build(chunks, vectors, "fake", str(tmp_path / "i"))
    before = spark.read.format("binaryFile").load(f"{folder}/impacts/*.parquet").agg(F.max("modificationTime")).first()[0]
    assert index.build(chunks, vectors, "fake", str(tmp_path / "i")) == folder
    assert spark.read.format("binaryFile").load(f"{folder}/impacts/*.parquet").agg(F.max("modificationTime")).first()[0] == before
    assert index.build(chunks, vectors, "other", str(tmp_path / "i")) != folder
    asked = spark.createDataFrame([(0, "rules of the bridge of mist"), (1, "zebra")], "query_id long, question string")
    rank = models.reranker(lambda: lambda q, p: [1.0 if "mist" in a and "mist" in b.lower() else 0.0 for a, b in zip(q, p)])
    got = search.search(asked, chunks, spark.read.parquet(f"{folder}/impacts"), asked.select("query_id", fake("question").alias("vector")), spark.read.parquet(f"{folder}/vectors"), 0.5, rerank=rank)
    rows = got.orderBy("rank").collect()
    assert {r["query_id"] for r in rows} == {0} and rows[0]["section_path"] == "Book > Bridge of mist" and rows[0]["book_page"] == 42
    assert [r["problem"] for r in index.validate(chunks.union(chunks)).collect()] == ["repeated chunk ids"]
    assert index.fingerprint("m", chunks).first() == index.fingerprint("m", chunks.orderBy(F.desc("id"))).first()


HITS = "array<struct<section_path:string,text:string,book_page:int>>"


def validated(spark, reply, hits=(("S", "The door costs 13 sparks and opens at dawn.", 42),)):
    df = spark.createDataFrame([(reply if isinstance(reply, str) else json.dumps(reply), list(hits))], f"raw string, hits {HITS}")
    return G.validated(df).first()


def claim(**over):
    return {"kind": "answer", "reply": "", "claims": [{"source": 0, "text": "It costs 13 sparks.", "quote": "The door costs 13 sparks"} | over]}


def test_a_grounded_claim(spark):
    assert validated(spark, claim())["answer"] == "It costs 13 sparks. (p. 42)"


@pytest.mark.parametrize("over", [{"source": 1}, {"source": -1}, {"text": "It costs 3 sparks."}, {"quote": "The door costs 13 spark"}, {"quote": "costs 13"}, {"text": "It costs 13 (p. 9)"}, {"text": " "}])
def test_other_claims_are_not_established(spark, over):
    assert validated(spark, claim(**over))["answer"] == G.NOT_ESTABLISHED


def test_pages_that_were_not_measured_prove_nothing(spark):
    assert validated(spark, claim(), [("S", "The door costs 13 sparks and opens.", None)])["answer"] == G.NOT_ESTABLISHED
    assert validated(spark, claim(), [])["answer"] == G.NOT_ESTABLISHED


@pytest.mark.parametrize(
    "reply,answer",
    [
        ({"kind": "refusal", "reply": "", "claims": []}, G.NOT_ESTABLISHED + " Section proche : S."),
        ({"kind": "refusal", "reply": G.NOT_FOUND_EN, "claims": []}, G.NOT_FOUND_EN + " Closest section: S."),
        ({"kind": "refusal", "reply": "no idea", "claims": []}, G.NOT_ESTABLISHED),
        ({"kind": "clarification", "reply": "Which door?", "claims": []}, "Which door?"),
        ({"kind": "clarification", "reply": "Door 3?", "claims": []}, G.NOT_ESTABLISHED),
        ({"kind": "clarification", "reply": "Say more.", "claims": []}, G.NOT_ESTABLISHED),
        ({"kind": "answer", "reply": "x", "claims": []}, G.NOT_ESTABLISHED),
        ({"kind": "answer", "reply": "", "claims": [], "extra": 1}, None),
        ("not json", None),
    ],
)
def test_replies(spark, reply, answer):
    got = validated(spark, reply)
    assert got["answer"] == answer and (got["error"] is None) == (answer is not None)


@pytest.mark.parametrize(
    "text,page,said,answer",
    [
        ("It costs 13 sparks. It opens.", 43, "It opens.", "It opens. (p. 43)"), ("It opens.", 43, "It opens. (p. 43)", "It opens. (p. 43)"), ("It opens.", 43, "It opens. (p. 3)", G.NOT_ESTABLISHED),
        ("It opens.", 43, "It opens. (pp. 43-99)", G.NOT_ESTABLISHED), ("It costs 13 sparks.", 43, "3 sparks.", G.NOT_ESTABLISHED), (None, 43, "x", G.NOT_FOUND), ("It opens.", None, "It opens.", G.NOT_ESTABLISHED),
    ],
)
def test_answers_from_a_passage(spark, text, page, said, answer):
    df = spark.createDataFrame([(text, page, said)], "t string, p int, a string")
    assert df.select(G.passage_answer(F.col("t"), F.col("p"), F.lit(True), F.col("a"))).first()[0] == answer


def test_prompts_history_and_guards(spark):
    turns = spark.createDataFrame([(1, k) for k in range(20)], "conv_id long, turn long")
    assert [r["turn"] for r in G.last_turns(turns).orderBy("turn").collect()] == list(range(8, 20))
    evidence = spark.createDataFrame([(0, k + 1, "S", "t" * 10) for k in range(8)], "query_id long, rank int, section_path string, text string")
    questions = spark.createDataFrame([(0, "q?")], "query_id long, question string")
    many = G.prompts(questions, evidence).first()
    assert many["prompt"] is None and many["problem"] == "too many hits"
    long = G.prompts(questions, evidence.where("rank = 1").withColumn("text", F.repeat(F.lit("t"), 80_001))).first()
    assert long["prompt"] is None and long["problem"] == "too much evidence"
    prompt = json.loads(G.prompts(questions, evidence.where("rank <= 6")).first()["prompt"])
    assert [e["source"] for e in prompt["evidence"]] == list(range(6)) and "page" not in str(prompt)
    assert G.guarded(evidence).first()["problem"] == "too many hits"
    replies = models.answered(spark.createDataFrame([(0, "p"), (1, "boom")], "query_id long, prompt string"), lambda: lambda p: p.upper() if p == "p" else (_ for _ in ()).throw(RuntimeError("secret"))).collect()
    assert sorted((r["query_id"], r["raw"], r["error"]) for r in replies) == [(0, "P", None), (1, None, "Generation failed")]
    with pytest.raises(RuntimeError):
        models.chat_client("http://localhost", " ", "m", "s")


QUESTIONS = [("a", "factual", [42], {}), ("b", "cross_section", [42, 43], {}), ("c", "out_of_book", [], {}), ("d", "factual", [50], {50: [42]})]


def cases(spark, hits):
    q = spark.createDataFrame([(i, c, "q", p, a, [], [], []) for i, c, p, a in QUESTIONS], files.QUESTION.replace("question string", "question string"))
    h = spark.createDataFrame(hits, "query_id string, rank int, book_page int, section_path string")
    return q, evaluation.retrieval_cases(q, h)


def test_recall_and_roll_up(spark):
    _, own = cases(spark, [("a", 1, 42, "S"), ("b", 1, 42, "S"), ("d", 1, 42, "S")])
    got = {r["id"]: (r["recall_at_6"], r["retrieval_refused"]) for r in own.collect()}
    assert got == {"a": (1.0, False), "b": (0.5, False), "c": (None, True), "d": (1.0, False)}
    sums = {r["category"]: r for r in evaluation.roll_up(own.where("id <> 'd'")).collect()}
    assert sums[None]["recall_at_6"] == 0.75 and sums["cross_section"]["recall_at_6"] == 0.5 and sums["out_of_book"]["refusal_rate"] == 1.0 and not sums[None]["target_met"]


def test_answers_are_checked(spark):
    _, own = cases(spark, [("a", 1, 42, "S"), ("b", 1, 42, "S"), ("b", 2, 43, "S")])
    answers = spark.createDataFrame([("a", "Yes (p. 42)", None), ("b", "Yes (p. 42)", None), ("c", G.NOT_FOUND, None), ("d", None, "Generation failed")], "id string, answer string, error string")
    got = {r["id"]: r for r in evaluation.answer_cases(own.join(answers, "id")).collect()}
    assert got["a"]["answer_checks_passed"] and got["b"]["citation_exact"] and not got["b"]["answer_checks_passed"] and got["c"]["correct_refusal"] and not got["d"]["answer_checks_passed"]
    total = evaluation.answer_roll_up(evaluation.answer_cases(own.join(answers, "id"))).first()
    assert total["generation_errors"] == 1 and not total["generation_target_met"] and total["correct_refusal"] == 1.0


def test_terms_are_compared_in_one_normal_form(spark):
    _, own = cases(spark, [("a", 1, 42, "S")])
    terms = [("STRASSE", ["\ufb01ne"], "x", True), ("stra\u00dfe", ["absent", "\uff26ine"], "x", True), ("Stra", ["fine"], "x", False), ("strasse", ["none"], "x", False), ("strasse", ["fine"], "\ufb01NE", False)]
    for all_, any_, none, passed in terms:
        case = own.where("id = 'a'").withColumns({"must_contain": F.array(F.lit(all_)), "must_contain_any": F.array(F.array(*map(F.lit, any_))), "must_not_hallucinate": F.array(F.lit(none)), "answer": F.lit("The  Stra\u00dfe is fine (p. 42)"), "error": F.lit(None).cast("string")})
        assert evaluation.answer_cases(case).first()["answer_checks_passed"] == passed


def test_dataset_checks(spark):
    q, _ = cases(spark, [])
    assert evaluation.dataset_problems(q).count() == 0
    bad = spark.createDataFrame([("x", "cross_section", "q", [3], {9: [1]}, [], [], []), ("x", "out_of_book", "q", [0, 0], {}, [], [], [])], files.QUESTION)
    assert evaluation.dataset_problems(bad).count() == 7
    assert {r["category"] for r in evaluation.dataset_balance(q).where("not enough").collect()} == set(evaluation.LEAST_CASES)


@pytest.mark.parametrize("positive,negative,threshold,accuracy", [([0.6, 0.035], [0.00002], 0.01, 1.0), ([0.003, 0.6], [0.00002], 0.001, 1.0), ([0.25, 0.014], [0.096, 0.00001], 0.1, 0.75)])
def test_calibration(spark, positive, negative, threshold, accuracy):
    df = spark.createDataFrame([(True, s) for s in positive] + [(False, s) for s in negative], "positive boolean, score double")
    got = evaluation.calibrated(evaluation.accuracy_grid(df)).first()
    assert got["threshold"] == pytest.approx(threshold) and got["accuracy"] == pytest.approx(accuracy)
    with pytest.raises(Exception, match="missing"):
        evaluation.calibrated(evaluation.accuracy_grid(df.where("positive"))).collect()


def test_case_scores(spark):
    rows = [(0, 1, 0.6, [1]), (0, 2, 0.9, [1]), (1, 1, 0.2, []), (1, 2, 0.3, [])]
    got = {r["query_id"]: (r["positive"], r["score"]) for r in evaluation.case_scores(spark.createDataFrame(rows, "query_id long, page int, score double, pages array<int>")).collect()}
    assert got == {0: (True, 0.6), 1: (False, 0.3)}


PROFILE = {"name": "p", "match": {"page_count": 4, "producer_contains": "Acro"}, "page_offset": -7, "drop_sections": ["Index"], "heading_overrides": {"camp": {"text": "Camp", "occurrence": 2}}}


def test_profiles(spark, tmp_path):
    reports = spark.createDataFrame([("b", 4, "Acrobat 9", None, "f" * 64, "B"), ("c", 4, None, None, None, "B")], "book_id string, page_count int, producer string, first_page_text_sha256 string, file_sha256 string, route string")
    own = profiles.frame(spark, [PROFILE | {"route": "A"}])
    got = {r["book_id"]: r for r in profiles.applied(reports, own).collect()}
    assert (got["b"]["profile"], got["b"]["route"], got["b"]["profile_offset"]) == ("p", "A", -7) and got["c"]["profile"] is None and got["c"]["route"] == "B"
    with pytest.raises(Exception, match="several"):
        profiles.applied(reports, profiles.frame(spark, [PROFILE, PROFILE | {"name": "q"}])).collect()
    for bad in ({"match": {"page_count": 4}}, {"match": {}}, {"boilerplate_patterns": ["("]}, {"table_pages": [0]}, {"other": 1}, {"match": {"file_sha256": "zz"}}):
        with pytest.raises(ValueError):
            profiles.validated(PROFILE | bad)
    (tmp_path / "a.json").write_text(json.dumps(PROFILE))
    (tmp_path / "b.yaml").write_text(profiles.template({"page_count": 4, "first_page_text_sha256": "a" * 64}, "made"))
    paths = files.profile_paths(spark, str(tmp_path))
    loaded = {r["name"]: r for r in files.load_profiles(spark, paths).collect()}
    assert set(loaded) == {"p", "made"} and loaded["made"]["first_page_text_sha256"] == "a" * 64 and loaded["p"]["heading_overrides"]["camp"]["occurrence"] == 2
    (tmp_path / "c.yaml").write_text("!!python/object/apply:os.system ['true']")
    with pytest.raises(Exception):
        files.load_profiles(spark, [str(tmp_path / "c.yaml")])


def test_question_and_calibration_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "a", "category": "factual", "question": "q", "expected_pages": [1]}]}))
    assert files.load_questions(spark, str(tmp_path / "q.json")).first()["must_contain_any"] == []
    (tmp_path / "c.json").write_text(json.dumps({"passages": [{"page": 1, "section": "s", "text": "t"}], "cases": [{"question": "q", "pages": [1]}]}))
    passages, own, digest = files.load_calibration(spark, str(tmp_path / "c.json"))
    assert passages.count() == own.count() == 1 and len(digest) == 64
    (tmp_path / "d.json").write_text(json.dumps({"passages": [{"page": 1, "section": "s", "text": "t"}], "cases": [{"question": "q", "pages": [2]}]}))
    with pytest.raises(ValueError):
        files.load_calibration(spark, str(tmp_path / "d.json"))


def test_hygiene(spark):
    paths = ["rules.pdf", "fixtures/a.pdf", "fixtures/b.pdf", "out/chunks.jsonl", ".env", "x/.env.local", "k.PEM", "home/.SSH/config", "secrets.yaml", "src/a.py", "big.bin", "data/x.txt"]
    listed = spark.createDataFrame([(p, 2 << 20 if p == "big.bin" else 10) for p in paths], "path string, bytes long")
    allowed = hygiene.declared(spark.createDataFrame([("see `fixtures/a.pdf`, made here",)], "text string"))
    got = {r["path"]: r["problem"] for r in hygiene.checked(listed, allowed).collect()}
    assert got == {"rules.pdf": "book outside fixtures", "fixtures/a.pdf": None, "fixtures/b.pdf": "undeclared fixture", "out/chunks.jsonl": "derived", ".env": "secret", "x/.env.local": "secret", "k.PEM": "secret", "home/.SSH/config": "secret", "secrets.yaml": "secret", "src/a.py": None, "big.bin": "too large", "data/x.txt": "derived"}


def test_files_and_outlines(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    own = files.digests(spark, str(tmp_path)).cache()
    assert own.first()["file_sha256"].startswith("ba7816bf")
    assert files.changed(own, own.select("path", F.lit("0").alias("file_sha256"))).count() == 1
    got = files.walked_outline(spark, [("A", 0, [("B", None, [])]), ("C", 3, [])], "b").collect()
    assert [(r["title"], r["level"], r["pdf_index"]) for r in got] == [("A", 1, 0), ("B", 2, None), ("C", 1, 3)]
    html = files.html_pages(spark.createDataFrame([(1, "<title>T &amp; U</title><style>p{}</style><script>x='</p>'</script><h1>Head</h1><!-- advert --><p>One <b>two</b> &lt;3</p>")], "page_id long, html string")).first()
    assert html["headings"] == ["Head"] and "One two <3" in html["text"] and "advert" not in html["text"]
