"""How good a text layer is, and which way of ingestion follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators.ingest import page_texts
from folioscan.operators.search import small

#: Short words of French and English that are no sign of broken recognition.
SHORT_WORDS = "a à y en de du le la un ce se ne et ou on il je tu si sa so au os an as at be by do go he if in is it me my no of or to up us we d6 d8 d4 1d 2d".split()
TEXT_PAGE = 20
SAMPLE_PAGES = 25


def quality(df: DataFrame, *keys: str, words: DataFrame | None = None) -> DataFrame:
    """Per row group: rates of broken characters and letters, mean token length, rate of odd short tokens,
    and, with a table of ``words`` (word), the share of longer tokens that are in it."""
    chars = F.length("text")
    odd = F.regexp_count("text", F.lit(r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}&&[^\n\t]]"))
    counts = df.groupBy(*keys).agg(F.sum(chars).alias("chars"), F.sum(F.regexp_count("text", F.lit("�"))).alias("broken"), F.sum(odd).alias("odd"), F.sum(F.regexp_count("text", F.lit(r"\p{L}"))).alias("letters"))
    tokens = df.select(*keys, F.explode(T.quality_tokens(F.col("text"))).alias("token"))
    short = (F.length("token") <= 2) & ~F.lower("token").isin(SHORT_WORDS)
    sums = tokens.groupBy(*keys).agg(F.avg(F.length("token")).alias("mean_token_length"), F.avg(short.cast("double")).alias("short_token_rate"))
    total = F.greatest("chars", F.lit(1))
    out = counts.join(sums, list(keys), "left").select(
        *keys, (F.col("broken") / total).alias("replacement_char_rate"), (F.col("odd") / total).alias("nonprintable_rate"), (F.col("letters") / total).alias("letter_ratio"),
        F.coalesce("mean_token_length", F.lit(0.0)).alias("mean_token_length"), F.coalesce("short_token_rate", F.lit(0.0)).alias("short_token_rate"),
    )
    if words is None:
        return out.withColumn("dictionary_hit_rate", F.lit(None).cast("double"))
    longer = tokens.where(F.length("token") > 3).select(*keys, F.btrim(F.lower("token"), F.lit("'-")).alias("word"))
    known = longer.join(words.select("word").distinct().withColumn("known", F.lit(1.0)), "word", "left")
    rate = known.groupBy(*keys).agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("dictionary_hit_rate"))
    return out.join(rate, list(keys), "left")


def sample_pages(pages: DataFrame) -> DataFrame:
    """(book_id, pdf_index): of each book the 25 pages with text that follow its first quarter of such pages.

    They are ranked without their texts, as a book is one task of the window.
    """
    own = Window.partitionBy("book_id")
    texts = pages.where(F.col("char_count") > TEXT_PAGE).select("book_id", "pdf_index").withColumns({"n": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("pdf_index")) - 1})
    start = F.floor(F.col("n") / 4)
    return texts.where((F.col("rank") >= start) & (F.col("rank") < start + SAMPLE_PAGES)).select("book_id", "pdf_index")


def embedded_fonts(fonts: DataFrame) -> DataFrame:
    """(book_id, embedded): how many fonts, by name and without the nameless, come with the book (book_id, font, embedded)."""
    held = F.when(F.col("embedded") & (F.col("font") != ""), F.col("font"))
    return fonts.groupBy("book_id").agg(F.count_distinct(held).alias("embedded"))


def verdicts(pages: DataFrame, fonts: DataFrame | None = None, words: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Per book: pages, text pages, median characters, verdict (absent, bad, suspect, native) and reasons.

    ``pages``: (book_id, pdf_index, char_count, text); with ``lines`` their texts are put together from these, for the
    sampled pages alone. ``fonts``: (book_id, embedded long), where known.
    """
    counts = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("page_count"), F.count_if(F.col("char_count") > TEXT_PAGE).alias("text_pages"), F.median("char_count").alias("median_chars"))
    sample, key = small(sample_pages(pages)), ["book_id", "pdf_index"]
    measured = quality(pages.join(sample, key, "left_semi") if lines is None else page_texts(lines.join(sample, key, "left_semi")), "book_id", words=words)
    all_ = counts.join(measured, "book_id", "left")
    all_ = all_.join(fonts, "book_id", "left") if fonts is not None else all_.withColumn("embedded", F.lit(1).cast("long"))
    ratio = F.col("text_pages") / F.greatest("page_count", F.lit(1))
    flags = F.array_compact(F.array(
        F.when(F.col("replacement_char_rate") > 0.005, "replacement characters"),
        F.when(F.col("nonprintable_rate") > 0.01, "unprintable characters"),
        F.when(F.col("letter_ratio") < 0.50, "few letters"),
        F.when(F.col("short_token_rate") > 0.35, "shredded words"),
        F.when(F.col("mean_token_length") < 3.0, "short words"),
        F.when(F.coalesce("embedded", F.lit(0)) == 0, "no embedded font"),
        F.when(ratio < 0.60, "many pages without text"),
    ))
    verdict = F.when(ratio < 0.05, "absent").when(F.size(flags) >= 2, "bad").when(F.size(flags) == 1, "suspect").otherwise("native")
    return all_.select("book_id", "page_count", "text_pages", "median_chars", ratio.alias("text_ratio"), "replacement_char_rate", "nonprintable_rate", "letter_ratio", "mean_token_length", "short_token_rate", "dictionary_hit_rate", verdict.alias("verdict"), F.when(ratio < 0.05, F.array(F.lit("no text"))).otherwise(flags).alias("reasons"))


def routes(reports: DataFrame) -> DataFrame:
    """Per book (verdict, usable, heavy): route A, B or C, a warning for suspect text, a remark on illustrations."""
    route = F.when(F.col("verdict").isin("absent", "bad"), "C").when(F.col("usable"), "A").otherwise("B")
    return reports.select("book_id", route.alias("route"), (F.col("verdict") == "suspect").alias("warned"), F.coalesce("heavy", F.lit(False)).alias("illustrated"))


def fingerprints(pages: DataFrame, least: int = 200) -> DataFrame:
    """Per book the SHA-256 of its first page with at least ``least`` characters of stripped text."""
    stripped = T.strip(F.col("text"))
    first = pages.where(F.length(stripped) >= least).groupBy("book_id").agg(F.min("pdf_index").alias("pdf_index"), F.min_by(F.sha2(stripped, 256), "pdf_index").alias("first_page_text_sha256"))
    return first
