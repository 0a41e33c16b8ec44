"""Evaluation of retrieval and answers, and calibration of the admission threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import grounding as G

ANSWERABLE = ("factual", "procedural", "cross_section")
#: The least number of cases of each category.
LEAST_CASES = {"factual": 10, "procedural": 8, "cross_section": 6, "ambiguous": 3, "out_of_book": 3}
TARGET = 0.85


def dataset_balance(questions: DataFrame, least: dict[str, int] = LEAST_CASES) -> DataFrame:
    """(category, n, least, enough) for every category that is asked for."""
    wanted = questions.sparkSession.createDataFrame(list(least.items()), "category string, least int")
    counted = questions.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counted, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "least", (F.coalesce("n", F.lit(0)) >= F.col("least")).alias("enough"))


def dataset_problems(questions: DataFrame) -> DataFrame:
    """(id, problem) for pages that are not positive or repeat, categories without or with pages they must or
    must not have, alternatives of other pages, and repeated ids."""
    pages = F.col("expected_pages")
    questions = questions.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("id")))
    checks = F.array_compact(F.array(
        F.when(F.exists(pages, lambda p: p < 1), "a page is not positive"),
        F.when(F.size(F.array_distinct(pages)) < F.size(pages), "a page repeats"),
        F.when(F.col("category").isin(*ANSWERABLE) & (F.size(pages) == 0), "no expected page"),
        F.when((F.col("category") == "cross_section") & (F.size(pages) < 2), "fewer than two pages"),
        F.when((F.col("category") == "out_of_book") & (F.size(pages) > 0), "pages out of the book"),
        F.when(F.size(F.array_except(F.map_keys("page_alternatives"), pages)) > 0, "alternatives of another page"),
        F.when(F.col("times") > 1, "the id repeats"),
    ))
    return questions.select("id", F.explode(checks).alias("problem"))


def page_groups(expected, alternatives):
    """Each expected page with those that may stand for it."""
    return F.transform(expected, lambda p: F.array_union(F.array(p), F.coalesce(F.try_element_at(alternatives, p), F.array().cast("array<int>"))))


def retrieval_cases(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question: retrieved pages in order, recall over its page groups (null if not answerable), refused."""
    ranked = hits.where("rank <= 6").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "book_page"))).alias("found"), F.min_by("section_path", "rank").alias("first_section"), F.min_by("book_page", "rank").alias("first_page"))
    rows = questions.join(ranked, questions.id == ranked.query_id, "left").drop("query_id")
    pages = F.array_distinct(F.array_compact(F.transform(F.coalesce("found", F.array().cast("array<struct<rank:int,book_page:int>>")), lambda x: x["book_page"])))
    groups = page_groups(F.col("expected_pages"), F.col("page_alternatives"))
    rows = rows.withColumns({"retrieved_pages": pages, "groups": groups})
    met = F.size(F.filter("groups", lambda g: F.arrays_overlap(g, F.col("retrieved_pages"))))
    recall = F.when(F.col("category").isin(*ANSWERABLE) & (F.size("groups") > 0), met / F.size("groups"))
    return rows.withColumns({"recall_at_6": recall, "retrieval_refused": F.col("found").isNull()}).drop("found")


def answer_cases(cases: DataFrame, from_hits: bool = True) -> DataFrame:
    """Cases with ``answer`` and ``error``: citations, their exactness, required and forbidden terms, refusals, clarifications.

    With ``from_hits`` all retrieved pages are evidence, else only the first hit's.
    """
    # Compared in one normal form, so that ligatures, full-width letters or ß and SS make no difference.
    cases = cases.withColumns({"_said": T.title_key(F.coalesce("answer", F.lit(""))), "_all": T.title_keys(F.col("must_contain")), "_any": T.title_keys(F.col("must_contain_any"), 2), "_none": T.title_keys(F.col("must_not_hallucinate"))})
    has = lambda term: T.contains_word(F.col("_said"), term)
    checks = F.forall("_all", has) & F.forall("_any", lambda group: F.exists(group, has)) & F.forall("_none", lambda term: ~has(term))
    cited = T.cited_pages(F.coalesce("answer", F.lit("")))
    evidence = F.col("retrieved_pages") if from_hits else F.array_compact(F.array("first_page"))
    rows = cases.withColumns({"checks": checks, "cited": cited, "evidence": evidence}).drop("_said", "_all", "_any", "_none")
    some = F.size("cited") > 0
    exact = some & (F.size(F.array_except("cited", F.flatten("groups"))) == 0) & (F.size(F.array_except("cited", "evidence")) == 0)
    answerable = F.col("category").isin(*ANSWERABLE)
    fine = F.col("checks") & exact & F.forall("groups", lambda g: F.arrays_overlap(g, F.col("cited"))) & F.col("error").isNull()
    refusals = F.array(*[F.lit(r) for r in G.REFUSALS], *[G.nearest(F.lit(r), F.col("first_section")) for r in G.REFUSALS])
    return rows.withColumns({
        "citation_present": F.when(answerable, some), "citation_exact": F.when(answerable, exact), "answer_checks_passed": F.when(answerable, fine),
        "correct_refusal": F.when(F.col("category") == "out_of_book", F.array_contains(refusals, F.col("answer")) & ~some),
        "correct_clarification": F.when(~answerable & (F.col("category") != "out_of_book"), (F.coalesce("answer", F.lit("")) != "") & F.contains("answer", F.lit("?")) & F.col("checks") & ~some),
    })


def roll_up(cases: DataFrame) -> DataFrame:
    """Mean recall for each category and overall (category null), nulls left out, and whether the target is met."""
    sums = cases.rollup("category").agg(F.count(F.lit(1)).alias("cases"), F.avg("recall_at_6").alias("recall_at_6"), F.avg(F.when(F.col("category") == "out_of_book", F.col("retrieval_refused").cast("double"))).alias("refusal_rate"))
    return sums.withColumn("target_met", F.coalesce(F.col("recall_at_6") >= TARGET, F.lit(False)))


def answer_roll_up(cases: DataFrame) -> DataFrame:
    """One row: means of the checks, each over the cases that have it; errors; whether every case passed one."""
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    names = ("answer_checks_passed", "citation_present", "citation_exact", "correct_refusal", "correct_clarification")
    passed = F.coalesce("answer_checks_passed", F.lit(False)) | F.coalesce("correct_refusal", F.lit(False)) | F.coalesce("correct_clarification", F.lit(False))
    return cases.agg(*[rate(c) for c in names], F.count("error").alias("generation_errors"), F.bool_and(passed).alias("generation_target_met"))


def case_scores(scored: DataFrame) -> DataFrame:
    """Per query (query_id, page, score, pages): the best score over its expected pages, or over all if it has none."""
    positive = F.size("pages") > 0
    own = F.when(~positive | F.array_contains("pages", F.col("page")), F.col("score"))
    return scored.groupBy("query_id", positive.alias("positive")).agg(F.max(own).alias("score"))


def accuracy_grid(cases: DataFrame, powers: int = 7) -> DataFrame:
    """(threshold, admitted, refused, accuracy) for 1, 0.1, 0.01, ...: the mean of both classes' shares."""
    grid = F.explode(F.array(*[F.lit(10.0**-n) for n in range(powers)])).alias("threshold")
    rows = cases.select("positive", "score", grid)
    admitted, refused = F.col("positive") & (F.col("score") >= F.col("threshold")), ~F.col("positive") & (F.col("score") < F.col("threshold"))
    sums = rows.groupBy("threshold").agg(F.count_if(admitted).alias("admitted"), F.count_if(refused).alias("refused"), F.count_if("positive").alias("positives"), F.count_if(~F.col("positive")).alias("negatives"), F.min(F.when(F.col("positive"), F.col("score"))).alias("minimum_positive"))
    return sums.withColumn("accuracy", (F.try_divide("admitted", "positives") + F.try_divide("refused", "negatives")) / 2)


def calibrated(grid: DataFrame) -> DataFrame:
    """The best threshold, the largest on ties. Missing classes, or a positive score of 0, are an error."""
    best = grid.agg(F.max_by(F.struct(*grid.columns), F.struct("accuracy", "threshold")).alias("best")).select("best.*")
    bad = F.col("accuracy").isNull() | ~(F.col("minimum_positive") > 0)
    return best.where(F.when(bad, F.raise_error(F.lit("classes or scores are missing"))).otherwise(F.lit(True)))
