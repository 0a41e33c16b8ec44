"""Printed page numbers: votes, runs of constant offset, and the page map. pdf_index = printed page + offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T

ZONE, MOST_NUMBER, FOLIO_SHARE = 0.12, 4000, 0.25


def zone(top, bottom, height):
    """header, footer or body by a line's place on its page."""
    return F.when(top < height * ZONE, "header").when(bottom > height * (1 - ZONE), "footer").otherwise("body")


def offset_votes(lines: DataFrame) -> DataFrame:
    """(book_id, pdf_index, kind, page_offset, n, ord): offsets that numbers in headers and footers propose."""
    line = T.strip(F.col("text"))
    alone = line.rlike("^[0-9]+$")
    edge = lines.where(zone(F.col("top"), F.col("bottom"), F.col("height")) != "body")
    found = edge.select(
        "book_id", "pdf_index", "line_no", F.when(alone, "standalone").otherwise("embedded").alias("kind"),
        F.posexplode(F.when(alone, F.array(line.try_cast("int"))).otherwise(T.integers(line))).alias("place", "value"),
    )
    found = found.where((F.col("value") > 0) & (F.col("value") <= MOST_NUMBER))
    offset = (F.col("pdf_index") - F.col("value")).cast("long")
    # First seen first: votes are told apart by their line and place.
    return found.groupBy("book_id", "pdf_index", "kind", offset.alias("page_offset")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "place")).alias("ord"))


def offset_support(votes: DataFrame) -> DataFrame:
    """Pages that propose each offset of a book."""
    return votes.groupBy("book_id", "kind", "page_offset").agg(F.countDistinct("pdf_index").alias("support"))


def chosen_offsets(votes: DataFrame) -> DataFrame:
    """Of each page the offset with most support in its book, then the smallest, then the first seen."""
    ranked = votes.join(offset_support(votes), ["book_id", "kind", "page_offset"])
    best = F.min_by("page_offset", F.struct(-F.col("support"), F.abs("page_offset"), "ord"))
    return ranked.groupBy("book_id", "kind", "pdf_index").agg(best.alias("page_offset"))


def raw_runs(chosen: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive pages with one offset, at least ``least`` long."""
    along = Window.partitionBy("book_id", "kind", "page_offset").orderBy("pdf_index")
    island = chosen.withColumn("island", F.col("pdf_index") - F.row_number().over(along))
    runs = island.groupBy("book_id", "kind", "page_offset", "island").agg(F.min("pdf_index").alias("pdf_start"), F.max("pdf_index").alias("pdf_end"))
    return runs.where(F.col("pdf_end") - F.col("pdf_start") + 1 >= least).drop("island")


def offset_runs(chosen: DataFrame) -> DataFrame:
    """Runs merged where the next one of the book has the same offset; ``measured`` counts pages that were read."""
    along = Window.partitionBy("book_id", "kind").orderBy("pdf_start")
    changed = F.when(F.lag("page_offset").over(along) == F.col("page_offset"), 0).otherwise(1)
    grouped = raw_runs(chosen).withColumn("changed", changed)
    grouped = grouped.withColumn("run", F.sum("changed").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    measured = F.sum(F.col("pdf_end") - F.col("pdf_start") + 1)
    return grouped.groupBy("book_id", "kind", "run").agg(F.min("pdf_start").alias("pdf_start"), F.max("pdf_end").alias("pdf_end"), F.min("page_offset").alias("page_offset"), measured.alias("measured")).drop("run")


def page_map(runs: DataFrame, books: DataFrame) -> DataFrame:
    """Per book (book_id, page_count): method, source, confidence, measured, covered, uniform_offset, disagrees.

    Whole-line numbers count if they were read on a quarter of the pages; else numbers inside lines, at half
    the confidence; else pages are numbered from 1.
    """
    lengths = runs.withColumn("pages", F.col("pdf_end") - F.col("pdf_start") + 1)
    weights = lengths.groupBy("book_id", "kind", "page_offset").agg(F.sum("pages").alias("pages"), F.min("pdf_start").alias("first"))
    dominant = weights.groupBy("book_id", "kind").agg(F.min_by("page_offset", F.struct(-F.col("pages"), "first")).alias("dominant"))
    sums = lengths.groupBy("book_id", "kind").agg(F.sum("measured").alias("measured"), F.sum("pages").alias("covered"), F.count(F.lit(1)).alias("runs"), F.min("page_offset").alias("only"))
    sums = sums.join(dominant, ["book_id", "kind"])
    wide = books
    for kind in ("standalone", "embedded"):
        own = sums.where(F.col("kind") == kind).select("book_id", F.struct("measured", "covered", "runs", "only", "dominant").alias(kind))
        wide = wide.join(own, "book_id", "left")
    pages = F.greatest("page_count", F.lit(1))
    folio = F.coalesce(F.col("standalone.measured"), F.lit(0)) >= FOLIO_SHARE * pages
    # No folios on no pages is no folio.
    folio = folio & (F.coalesce(F.col("standalone.measured"), F.lit(0)) > 0)
    inner = F.coalesce(F.col("embedded.measured"), F.lit(0)) > 0
    used = F.when(folio, F.col("standalone")).when(inner, F.col("embedded"))
    wide = wide.withColumns({"used": used, "source": F.when(folio, "standalone").when(inner, "embedded").otherwise("none")})
    share = F.coalesce(F.col("used.measured"), F.lit(0)) / pages
    return wide.select(
        "book_id", "page_count", F.when(F.col("source") == "none", "identity").otherwise("printed").alias("method"), "source",
        F.when(F.col("source") == "embedded", share * 0.5).otherwise(share).alias("confidence"),
        F.coalesce("used.measured", F.lit(0)).cast("long").alias("measured"), F.coalesce("used.covered", F.lit(0)).cast("long").alias("covered"),
        F.when((F.col("used.runs") == 1) & (F.col("used.covered") >= 0.9 * pages), F.col("used.only")).alias("uniform_offset"),
        F.coalesce(folio & (F.col("embedded.dominant") != F.col("standalone.dominant")) & (F.col("embedded.measured") >= 0.5 * pages), F.lit(False)).alias("disagrees"),
    )


def used_runs(runs: DataFrame, maps: DataFrame) -> DataFrame:
    """The runs of each book's chosen source."""
    return runs.join(maps.select("book_id", F.col("source").alias("kind")), ["book_id", "kind"])


def printed_pages(pages: DataFrame, runs: DataFrame, maps: DataFrame) -> DataFrame:
    """(book_id, pdf_index, book_page): the printed page by an interval lookup written as an equi-join on pages.

    Without a measured map pages are numbered from 1; outside all runs the page is null.
    """
    spread = runs.select("book_id", F.explode(F.sequence("pdf_start", "pdf_end")).alias("pdf_index"), "pdf_start", "page_offset")
    first = spread.groupBy("book_id", "pdf_index").agg(F.min_by("page_offset", "pdf_start").alias("page_offset"))
    held = pages.select("book_id", "pdf_index").join(maps.select("book_id", "method"), "book_id").join(first, ["book_id", "pdf_index"], "left")
    page = F.when(F.col("method") == "identity", F.col("pdf_index") + 1).otherwise(F.col("pdf_index") - F.col("page_offset"))
    return held.select("book_id", "pdf_index", page.cast("long").alias("book_page"))


def profile_map(books: DataFrame) -> DataFrame:
    """(book_id, pdf_start, pdf_end, page_offset) of the one run that a profile's offset stands for."""
    return books.where("page_offset is not null").select("book_id", F.greatest(F.lit(0), F.col("page_offset") + 1).cast("long").alias("pdf_start"), (F.col("page_count") - 1).cast("long").alias("pdf_end"), F.col("page_offset").cast("long").alias("page_offset"))
