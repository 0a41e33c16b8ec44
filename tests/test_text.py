import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "line,mask",
    [("  Corp 2008 Mongoose:Layout 1  Page 12 ", "corp # mongoose:layout # page #"), ("\tA  B\n", "a b"), ("", ""), ("١٢ x", "# x")],
)
def test_mask_line(spark, line, mask):
    assert one(spark, T.mask_line(F.col("t")), t=line) == mask


def test_title_key(spark):
    assert one(spark, T.title_key(F.col("t")), t="  ﬁnal  STRASSE ß ") == "final strasse ss"
    assert one(spark, T.title_key(F.col("t")), t=None) is None


@pytest.mark.parametrize("text,term,found", [("page 13 of", "3", False), ("a 3 b", "3", True), ("3", "3", True), ("a.b", ".", False), ("x (y) z", "(y)", True), ("été", "t", False)])
def test_contains_word(spark, text, term, found):
    assert one(spark, T.contains_word(F.col("t"), F.col("w")), t=text, w=term) is found


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t=" One.  Two?\nThree! four") == ["One.", "Two?", "Three!", "four"]


@pytest.mark.parametrize("text,n", [("", 0), ("abc", 1), ("abcd", 2), ("éé", 2)])
def test_estimated_tokens(spark, text, n):
    assert one(spark, T.estimated_tokens(F.col("t")), t=text) == n


@pytest.mark.parametrize("line,is_", [("CROSSING", True), (" A-1 ", True), ("12", False), ("", False), ("Aa", False), ("A" * 121, False)])
def test_is_heading(spark, line, is_):
    assert one(spark, T.is_heading(F.col("t")), t=line) is is_


def test_numbers_and_pages(spark):
    assert one(spark, T.numbers(F.col("t")), t="x7 -3,5% and +2 8") == ["-3,5%", "+2", "8"]
    assert one(spark, T.cited_pages(F.col("t")), t="a (p. 3) b (p.12) c (p. 3)") == [3, 12]
    assert one(spark, T.referenced_pages(F.col("t")), t="(p. 3) and pages 43-99, pp. 4 et 5") == [3, 43, 99, 4, 5]
    assert one(spark, T.terms(F.col("t")), t="L'Été: a_b 3") == ["l", "été", "a_b", "3"]


def test_toc_pairs_of_a_merged_line(spark):
    got = one(spark, T.toc_pairs(F.col("t")), t="Game Terms 7 How are Telepathics Possible? 72")
    assert [(p["title"], p["page"]) for p in got] == [("Game Terms", 7), ("How are Telepathics Possible?", 72)]


@pytest.mark.parametrize("path,suffix", [("a/B.PDF", ".pdf"), (".env", ""), ("x/.env.local", ".local"), ("a.tar.gz", ".gz"), ("none", "")])
def test_suffix(spark, path, suffix):
    assert one(spark, T.suffix(F.col("t")), t=path) == suffix


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] and round(r[0], 6) for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None]
