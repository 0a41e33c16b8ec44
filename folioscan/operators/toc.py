"""Tables of contents in the text, and page maps from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators.search import small

LEAST_PAIRS, LEAST_DENSITY, SEARCH = 8, 0.55, 0.12


def front(page_count):
    """Pages at a book's front in which a table of contents is looked for."""
    return F.greatest(F.lit(20), F.floor(page_count * SEARCH))


def toc_entries(lines: DataFrame, masks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(book_id, pdf_index, line_no, place, title, page) of the front pages dense with title and number pairs."""
    masked = lines.join(page_counts, "book_id").where(F.col("pdf_index") < front(F.col("page_count"))).withColumn("masked", T.mask_line(F.col("text")))
    body = masked.join(masks.select("book_id", "masked"), ["book_id", "masked"], "left_anti")
    good = F.filter(T.toc_pairs(F.col("text")), lambda p: (F.length(p["title"]) >= 4) & (p["page"] > 0) & (p["page"] <= F.col("page_count")))
    body = body.withColumn("pairs", good)
    dense = body.groupBy("book_id", "pdf_index").agg(F.sum(F.size("pairs")).alias("n"), F.avg((F.size("pairs") > 0).cast("double")).alias("density"))
    dense = dense.where((F.col("n") >= LEAST_PAIRS) & (F.col("density") >= LEAST_DENSITY)).select("book_id", "pdf_index")
    pairs = body.join(dense, ["book_id", "pdf_index"], "left_semi").select("book_id", "pdf_index", "line_no", F.posexplode("pairs").alias("place", "pair"))
    return pairs.select("book_id", "pdf_index", "line_no", "place", F.col("pair.title").alias("title"), F.col("pair.page").alias("page"))


def toc_report(entries: DataFrame) -> DataFrame:
    """Per book: pages of the table, entries, and the first six as a sample."""
    order = F.struct("pdf_index", "line_no", "place", F.concat_ws(" … ", "title", F.col("page").cast("string")).alias("shown"))
    # A sorted top six per book before anything is gathered.
    ranked = entries.withColumn("r", F.row_number().over(Window.partitionBy("book_id").orderBy("pdf_index", "line_no", "place")))
    sample = ranked.where("r <= 6").groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["shown"]).alias("sample"))
    return entries.groupBy("book_id").agg(F.sort_array(F.collect_set("pdf_index")).alias("pages"), F.count(F.lit(1)).alias("entry_count")).join(sample, "book_id")


def located_titles(entries: DataFrame, lines: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(book_id, entry, page, pdf_index): the first later page, behind the front, with a line that is or begins with the title.

    Titles meet lines on their first four characters, then the whole condition is checked.
    """
    wanted = entries.select("book_id", F.col("pdf_index").alias("toc_index"), "line_no", "place", "page", T.mask_line(F.col("title")).alias("title")).where(F.length("title") >= 4).withColumn("head", F.substring("title", 1, 4))
    later = lines.join(page_counts, "book_id").where(F.col("pdf_index") >= front(F.col("page_count"))).select("book_id", "pdf_index", T.mask_line(F.col("text")).alias("masked"))
    later = later.withColumn("head", F.substring("masked", 1, 4)).join(small(wanted.select("book_id", "head").distinct()), ["book_id", "head"], "left_semi").distinct()
    met = wanted.join(later, ["book_id", "head"]).where((F.col("pdf_index") > F.col("toc_index")) & ((F.col("masked") == F.col("title")) | ((F.length("title") >= 8) & F.startswith("masked", F.col("title")))))
    return met.groupBy("book_id", "toc_index", "line_no", "place", "page").agg(F.min("pdf_index").alias("pdf_index"))


def toc_page_map(located: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Per book with at least three located titles of one offset and strictly rising pages: its one run."""
    along = Window.partitionBy("book_id").orderBy("pdf_index", "page")
    falls = (F.lag("pdf_index").over(along) >= F.col("pdf_index")) | (F.lag("page").over(along) >= F.col("page"))
    checked = located.withColumn("falls", F.coalesce(falls, F.lit(False)))
    offset = F.col("pdf_index") - F.col("page")
    sums = checked.groupBy("book_id").agg(F.count(F.lit(1)).alias("matched"), F.min(offset).alias("low"), F.max(offset).alias("high"), F.bool_or("falls").alias("falls"), F.min("pdf_index").alias("pdf_start"), F.max("pdf_index").alias("pdf_end"))
    good = sums.where((F.col("matched") >= 3) & (F.col("low") == F.col("high")) & ~F.col("falls") & (F.col("pdf_start") - F.col("low") >= 1)).join(page_counts, "book_id")
    covered = F.col("pdf_end") - F.col("pdf_start") + 1
    return good.select("book_id", F.col("pdf_start").cast("long").alias("pdf_start"), F.col("pdf_end").cast("long").alias("pdf_end"), F.col("low").cast("long").alias("page_offset"), F.col("matched"), F.least(F.lit(0.5), F.col("matched") / F.col("page_count")).alias("confidence"), F.when(covered >= 0.9 * F.col("page_count"), F.col("low")).alias("uniform_offset"))


def with_toc_maps(maps: DataFrame, toc_maps: DataFrame) -> DataFrame:
    """Page maps in which books without printed numbers take the map of their table of contents, if there is one."""
    own = toc_maps.select("book_id", F.struct("matched", "confidence", "uniform_offset", (F.col("pdf_end") - F.col("pdf_start") + 1).alias("covered")).alias("toc"))
    held = maps.join(own, "book_id", "left")
    use = (F.col("method") == "identity") & F.col("toc").isNotNull()
    pick = lambda a, b: F.when(use, a).otherwise(F.col(b)).alias(b)
    return held.select("book_id", "page_count", pick(F.lit("toc"), "method"), "source", pick(F.col("toc.confidence"), "confidence"), pick(F.col("toc.matched"), "measured"), pick(F.col("toc.covered"), "covered"), pick(F.col("toc.uniform_offset"), "uniform_offset"), "disagrees")
