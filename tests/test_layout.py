import time

import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import layout, outline, pagemap, textlayer, toc

SCHEMA = "book_id string, pdf_index long, line_no int, text string, x0 double, top double, bottom double, width double, height double"


def book(spark, pages, foot=None, x0=lambda i, k: 60.0, head=None):
    """Pages of 600 x 800: body lines from 200 in steps of 12, a header at 40, a footer at 760."""
    rows = []
    for i, body in enumerate(pages):
        own = ([(40.0, head(i))] if head and head(i) else []) + [(200.0 + 12 * k, t) for k, t in enumerate(body)] + ([(760.0, foot(i))] if foot and foot(i) is not None else [])
        rows += [("b", i, k, t, x0(i, k), top, top + 10, 600.0, 800.0) for k, (top, t) in enumerate(own)]
    return spark.createDataFrame(rows, SCHEMA)


def counts(spark, n):
    return spark.createDataFrame([("b", n)], "book_id string, page_count long")


def test_repeated_footers_are_boilerplate(spark):
    lines = book(spark, [[f"body {chr(97 + i % 26)}{chr(97 + i // 26)}"] + (["rare"] if i < 5 else []) for i in range(50)], lambda i: f"Corp 2008 Mongoose:Layout 1 Page {i + 1}")
    got = layout.boilerplate(lines, counts(spark, 50)).collect()
    assert [(r["masked"], r["page_ratio"], r["zone"], r["example"]) for r in got] == [("corp # mongoose:layout # page #", 1.0, "footer", "Corp 2008 Mongoose:Layout 1 Page 1")]
    kept = layout.without_boilerplate(lines, layout.boilerplate(lines, counts(spark, 50)), [r"^rare$"])
    assert kept.count() == 50


def test_the_ratio_is_inclusive(spark):
    lines = book(spark, [["same line"] if i < 6 else ["other %s" % chr(97 + i)] for i in range(10)])
    assert layout.boilerplate(lines, counts(spark, 10)).count() == 1
    assert layout.boilerplate(lines, counts(spark, 10), 0.61).count() == 0


def mapped(spark, lines, n):
    votes = pagemap.offset_votes(lines)
    runs = pagemap.offset_runs(pagemap.chosen_offsets(votes)).cache()
    maps = pagemap.page_map(runs, counts(spark, n))
    pages = spark.range(n).selectExpr("'b' as book_id", "id as pdf_index")
    printed = {r["pdf_index"]: r["book_page"] for r in pagemap.printed_pages(pages, pagemap.used_runs(runs, maps), maps).collect()}
    return maps.first(), sorted((r["kind"], r["pdf_start"], r["pdf_end"], r["page_offset"]) for r in runs.collect()), printed


def test_uniform_folios(spark):
    m, runs, printed = mapped(spark, book(spark, [["x"]] * 40, lambda i: str(i + 1)), 40)
    assert (m["method"], m["source"], m["uniform_offset"], m["confidence"]) == ("printed", "standalone", -1, 1.0)
    assert runs == [("standalone", 0, 39, -1)] and printed[7] == 8


def test_two_runs(spark):
    m, runs, printed = mapped(spark, book(spark, [["x"]] * 40, lambda i: str(i + 1 if i < 20 else i - 3)), 40)
    assert m["uniform_offset"] is None and len(runs) == 2 and (printed[5], printed[25]) == (6, 22)


def test_folios_inside_lines_and_years(spark):
    m, _, printed = mapped(spark, book(spark, [["x"]] * 40, lambda i: f"Copyright 2009 — {i + 1}"), 40)
    assert m["source"] == "embedded" and m["confidence"] == 0.5 and m["uniform_offset"] == -1 and printed[0] == 1


def test_folios_win_over_imposition(spark):
    m, _, _ = mapped(spark, book(spark, [["x"]] * 40, lambda i: str(i + 4), head=lambda i: f"Page {i}"), 40)
    assert (m["source"], m["uniform_offset"], m["disagrees"]) == ("standalone", -4, True)


def test_gaps_are_bridged_but_not_measured(spark):
    m, runs, printed = mapped(spark, book(spark, [["x"]] * 40, lambda i: None if 17 <= i <= 19 else str(i + 1)), 40)
    assert m["measured"] == 37 and m["covered"] == 40 and runs == [("standalone", 0, 39, -1)] and printed[18] == 19


def test_no_numbers(spark):
    m, _, printed = mapped(spark, book(spark, [["chapter 12"]] * 10, lambda i: "footer"), 10)
    assert (m["method"], m["confidence"]) == ("identity", 0.0) and printed[7] == 8


def test_a_profile_offset_is_one_run(spark):
    df = spark.createDataFrame([("b", 20, -7)], "book_id string, page_count long, page_offset int")
    assert tuple(pagemap.profile_map(df).first()) == ("b", 0, 19, -7)


@pytest.mark.parametrize("starts,dominant,stable", [((60, 320), 2, True), ((60,), 1, True)])
def test_columns(spark, starts, dominant, stable):
    lines = book(spark, [[f"l{k}" for k in range(20)]] * 60, x0=lambda i, k: float(starts[k % len(starts)]))
    got = layout.column_report(layout.page_columns(lines)).first()
    assert (got["dominant"], got["stable"]) == (dominant, stable)


def test_unstable_columns(spark):
    lines = book(spark, [[f"l{k}" for k in range(30)]] * 40, x0=lambda i, k: float((60, 320)[k % 2] if i < 20 else (60, 230, 400)[k % 3]))
    got = layout.column_report(layout.page_columns(lines)).first()
    assert not got["stable"] and set(got["distribution"]) == {2, 3}


def test_sampled_pages(spark):
    pages = spark.range(100).selectExpr("'b' as book_id", "id as pdf_index")
    got = sorted(r["pdf_index"] for r in layout.sampled_pages(pages).collect())
    assert got == list(range(25, 85, 3))


def test_shadows(spark):
    glyphs = spark.createDataFrame([("b", 0, k, "char", t, x, y) for k, (t, x, y) in enumerate([("3", 10.0, 5.0), ("3", 10.9, 5.4), ("8", 16.0, 5.0), ("8", 16.4, 5.0), ("7", 30.0, 5.0), ("7", 38.0, 5.0)])] + [("b", 1, 0, "char", "3", 10.0, 5.0)], "book_id string, page long, seq int, object_type string, text string, x0 double, top double")
    got = sorted((r["page"], r["seq"]) for r in layout.without_shadows(glyphs).collect())
    assert got == [(0, 0), (0, 2), (0, 4), (0, 5), (1, 0)]


def test_images(spark):
    images = spark.createDataFrame([("b", 120, 120, 9000), ("b", 80, 80, 9000), ("b", 120, 120, 300)], "book_id string, w int, h int, bytes int")
    got = layout.image_report(images, counts(spark, 2)).first()
    assert (got["images"], got["large"], got["heavy"]) == (3, 2, True) and layout.kept_images(images).count() == 1
    sizes = spark.createDataFrame([(None, None, -5.0, 6.0), (7.0, 8.0, 1.0, 1.0)], "a double, b double, c double, d double").select(layout.image_size(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s")).collect()
    assert [tuple(r["s"]) for r in sizes] == [(5.0, 6.0), (7.0, 8.0)]


TOC = [f"Chapter of things {chr(97 + k)} ..... {k + 1}" for k in range(10)]


def none(spark):
    return spark.createDataFrame([], "book_id string, masked string")


def test_tables_of_contents(spark):
    lines = book(spark, [TOC] + [["prose without pairs"]] * 20)
    got = toc.toc_report(toc.toc_entries(lines, none(spark), counts(spark, 21))).first()
    assert got["pages"] == [0] and got["entry_count"] == 10 and len(got["sample"]) == 6
    table = book(spark, [["Assault rifle 12", "more prose here", "and again prose", "still prose"]] + [["x"]] * 20)
    assert toc.toc_entries(table, none(spark), counts(spark, 21)).count() == 0


def test_long_lines_with_few_numbers_are_searched_for_contents_at_once(spark):
    """Every letter used to be tried as the first of a title: 17 s for such 1 MB."""
    line = "so the ferry left at dawn and " * 100
    lines = spark.range(0, 400, 1, 1).select(F.concat(F.lit(line + "Deck plan .... 7 "), F.lit(line + "Crew 12")).alias("text"))
    start = time.perf_counter()
    got = lines.select(T.toc_pairs(F.col("text")).alias("pairs")).groupBy("pairs").count().collect()
    assert [([p["page"] for p in r["pairs"]], r["count"]) for r in got] == [([7, 12], 400)] and time.perf_counter() - start < 12
    titles = [p["title"] for p in got[0]["pairs"]]
    assert all(len(t) <= 71 and t.endswith(end) for t, end in zip(titles, ("Deck plan", "Crew"), strict=True)), titles


def toc_book(spark, where):
    pages = [[] for _ in range(40)]
    titles = ["Alpha chapter", "Bravo chapter", "Gamma chapter"] + [f"Missing {chr(97 + k)} title" for k in range(7)]
    printed = [24, 30, 36] + [10] * 7
    pages[0] = [f"{t} .... {p}" for t, p in zip(titles, printed)]
    for t, i in zip(titles, where):
        pages[i] = [t, "text"]
    return book(spark, [p or ["nothing"] for p in pages])


def test_a_page_map_from_contents(spark):
    lines, c = toc_book(spark, [22, 28, 34]), counts(spark, 40)
    located = toc.located_titles(toc.toc_entries(lines, none(spark), c), lines, c)
    got = toc.toc_page_map(located, c)
    assert tuple(got.first())[:6] == ("b", 22, 34, -2, 3, 3 / 40) and got.first()["uniform_offset"] is None
    maps = pagemap.page_map(spark.createDataFrame([], "book_id string, kind string, pdf_start long, pdf_end long, page_offset long, measured long"), c)
    assert toc.with_toc_maps(maps, got).first()["method"] == "toc"


def test_contradicting_titles_give_no_map(spark):
    lines, c = toc_book(spark, [22, 31, 34]), counts(spark, 40)
    assert toc.toc_page_map(toc.located_titles(toc.toc_entries(lines, none(spark), c), lines, c), c).count() == 0


def entries(spark, rows):
    return spark.createDataFrame([("b", k, t, level, p) for k, (t, level, p) in enumerate(rows)], "book_id string, ord long, title string, level int, pdf_index long")


def test_section_paths_drop_stale_children(spark):
    rows = [("A", 1, 0), ("B", 2, 0), ("C", 3, 0), ("D", 2, 1), ("E", 3, 2), ("F", 1, 3), ("G", 2, 3)]
    got = [r["section_path"] for r in outline.section_paths(entries(spark, rows)).orderBy("ord").collect()]
    assert got == ["A", "A > B", "A > B > C", "A > D", "A > D > E", "F", "F > G"]
    assert outline.level_jumps(entries(spark, [("A", 1, 0), ("C", 3, 0)])).count() == 1


def test_section_paths_of_any_depth(spark):
    rows = [(f"t{k}", k, 0) for k in range(1, 21)] + [("u", 20, 1), ("v", 13, 1), ("w", 14, 1), ("x", 2, 2)]
    got = [r["section_path"] for r in outline.section_paths(entries(spark, rows)).orderBy("ord").collect()]
    above = [f"t{k}" for k in range(1, 21)]
    want = [above[: k + 1] for k in range(20)] + [[*above[:19], "u"], [*above[:12], "v"], [*above[:12], "v", "w"], ["t1", "x"]]
    assert got == [" > ".join(x) for x in want]
    assert outline.section_paths(entries(spark, rows).limit(0)).count() == 0


def test_outline_usability(spark):
    good = outline.outline_report(entries(spark, [(f"t{k}", 1, 4 * k) for k in range(12)]), counts(spark, 48)).first()
    assert good["usable"] and good["coverage"] == 1.0 and good["max_span"] == 4
    bad = outline.outline_report(entries(spark, [("t", 1, 40), ("u", 1, None)]), counts(spark, 48)).first()
    assert not bad["usable"] and bad["reasons"] == ["few entries", "unresolved entries", "low coverage"] and bad["largest_gap"] == 40
    none_ = outline.outline_report(entries(spark, [("t", 1, 0)]).limit(0), counts(spark, 48)).first()
    assert none_["entries"] == 0 and not none_["usable"]


def pages(spark, texts):
    return spark.createDataFrame([("b", i, t, len(t)) for i, t in enumerate(texts)], "book_id string, pdf_index long, text string, char_count int")


@pytest.mark.parametrize(
    "text,verdict",
    [("Le combat se joue en rounds et chaque joueur annonce une action avant de lancer les dés.", "native"), ("L c m b t s j q r n d t c h q f g h k l", "bad"), ("Texte �� lisible mais troué de signes perdus partout", "suspect"), ("", "absent")],
)
def test_text_verdicts(spark, text, verdict):
    got = textlayer.verdicts(pages(spark, [text] * 10)).first()
    assert got["verdict"] == verdict, got


def test_dictionary_rate_and_fingerprint(spark):
    words = spark.createDataFrame([("combat",), ("chaque",)], "word string")
    got = textlayer.quality(pages(spark, ["combat chaque inconnu"]), "book_id", words=words).first()
    assert got["dictionary_hit_rate"] == pytest.approx(2 / 3)
    first = textlayer.fingerprints(pages(spark, ["short", "y" * 250, "z" * 250])).first()
    assert first["pdf_index"] == 1


@pytest.mark.parametrize("verdict,usable,heavy,route", [("absent", True, False, "C"), ("bad", True, False, "C"), ("suspect", True, True, "A"), ("native", False, False, "B")])
def test_routes(spark, verdict, usable, heavy, route):
    got = textlayer.routes(spark.createDataFrame([("b", verdict, usable, heavy)], "book_id string, verdict string, usable boolean, heavy boolean")).first()
    assert (got["route"], got["warned"], got["illustrated"]) == (route, verdict == "suspect", heavy)
