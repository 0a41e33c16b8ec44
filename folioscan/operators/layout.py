"""Repeated lines, columns, images and glyphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators.pagemap import zone
from folioscan.operators.search import small
from folioscan.sources.staging import staged

BOILERPLATE_RATIO = 0.60
COLUMN_PAGES, COLUMN_GAP, COLUMN_SHARE = 20, 0.06, 0.12
IMAGE_PIXELS, IMAGE_BYTES = 100, 5000


def boilerplate(lines: DataFrame, page_counts: DataFrame, ratio: float = BOILERPLATE_RATIO, approximate: bool = False) -> DataFrame:
    """(book_id, masked, page_count, page_ratio, example, zone): masked lines on at least ``ratio`` of a book's pages.

    The example is the first seen; the zone is the most frequent, the first seen on ties. ``approximate``
    counts pages with a sketch, for books of very many pages. Pages are first counted by hashes of the lines, so that
    only lines that may be repeated often enough (clashing hashes add some, and take none) are shuffled as texts.
    """
    seen = lines.select("book_id", "pdf_index", "line_no", "text", T.mask_line(F.col("text")).alias("masked"), zone(F.col("top"), F.col("bottom"), F.col("height")).alias("zone"))
    seen = seen.where(F.length("masked") >= 4)
    held = page_counts.withColumnRenamed("page_count", "pages")
    pages = F.approx_count_distinct("pdf_index") if approximate else F.count_distinct("pdf_index")
    often = seen.groupBy("book_id", F.xxhash64("masked").alias("digest")).agg(pages.alias("n")).join(held, "book_id").where(F.col("n") / F.col("pages") >= ratio)
    often = small(staged(often, "often"))
    seen = seen.withColumn("digest", F.xxhash64("masked")).join(often.select("book_id", "digest"), ["book_id", "digest"], "left_semi")
    order = F.struct("pdf_index", "line_no")
    zones = seen.groupBy("book_id", "masked", "zone").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    modal = zones.groupBy("book_id", "masked").agg(F.min_by("zone", F.struct(-F.col("n"), "first")).alias("zone"))
    counted = seen.groupBy("book_id", "masked").agg(pages.alias("page_count"), F.min_by(T.strip(F.col("text")), order).alias("example"))
    counted = counted.join(held, "book_id").withColumn("page_ratio", F.col("page_count") / F.col("pages"))
    return counted.where(F.col("page_ratio") >= ratio).join(modal, ["book_id", "masked"]).select("book_id", "masked", "page_count", "page_ratio", "example", "zone")


def without_boilerplate(lines: DataFrame, patterns: DataFrame, regexes: list[str] = ()) -> DataFrame:
    """Lines whose masked form is no pattern of their book and that no regex of a profile finds."""
    kept = lines.withColumn("masked", T.mask_line(F.col("text"))).join(patterns.select("book_id", "masked"), ["book_id", "masked"], "left_anti").drop("masked")
    for regex in regexes:
        kept = kept.where(~F.col("text").rlike(regex))
    return kept


def without_folios(lines: DataFrame, printed: DataFrame, maps: DataFrame) -> DataFrame:
    """Lines but those in headers and footers that are their own page's printed number, where folios were read."""
    named = lines.join(printed, ["book_id", "pdf_index"], "left").join(maps.select("book_id", "source"), "book_id", "left")
    folio = (F.col("source") == "standalone") & (T.strip(F.col("text")) == F.col("book_page").cast("string")) & (zone(F.col("top"), F.col("bottom"), F.col("height")) != "body")
    return named.where(~F.coalesce(folio, F.lit(False))).drop("book_page", "source")


def sampled_pages(pages: DataFrame, most: int = COLUMN_PAGES, span: int = 60) -> DataFrame:
    """Of each book up to ``most`` pages, evenly from a window of ``span`` pages after its first quarter."""
    own = Window.partitionBy("book_id")
    placed = pages.withColumns({"n": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("pdf_index")) - 1})
    start = F.floor(F.col("n") / 4)
    size = F.least(F.lit(span), F.col("n") - start)
    step = F.greatest(F.lit(1), F.floor(size / most))
    within = F.col("rank") - start
    return placed.where((within >= 0) & (within < size) & (within % step == 0) & (within / step < most)).drop("n", "rank")


def start_clusters(lines: DataFrame, gap: float = COLUMN_GAP) -> DataFrame:
    """(book_id, pdf_index, cluster, starts, left): line starts of a page joined while gaps are at most ``gap`` of its width."""
    along = Window.partitionBy("book_id", "pdf_index").orderBy("x0", "line_no")
    new = F.when(F.col("x0") - F.lag("x0").over(along) > F.col("width") * gap, 1).otherwise(0)
    clustered = lines.withColumn("new", new).withColumn("cluster", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return clustered.groupBy("book_id", "pdf_index", "cluster").agg(F.count(F.lit(1)).alias("starts"), F.min("x0").alias("left"))


def page_columns(lines: DataFrame) -> DataFrame:
    """(book_id, pdf_index, columns): clusters that hold at least an eighth or so of the page's line starts."""
    clusters = start_clusters(lines)
    total = F.sum("starts").over(Window.partitionBy("book_id", "pdf_index"))
    big = clusters.withColumn("big", F.col("starts") >= COLUMN_SHARE * total)
    return big.groupBy("book_id", "pdf_index").agg(F.greatest(F.lit(1), F.count_if("big")).alias("columns"))


def column_report(columns: DataFrame) -> DataFrame:
    """Per book: dominant number of columns, how often each occurs, variance, stable."""
    counted = columns.groupBy("book_id", "columns").agg(F.count(F.lit(1)).alias("n"))
    report = counted.groupBy("book_id").agg(
        F.min_by("columns", F.struct(-F.col("n"), "columns")).alias("dominant"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("columns", "n")))).alias("distribution"),
        (F.sum(F.col("n") * F.col("columns") * F.col("columns")) / F.sum("n") - F.pow(F.sum(F.col("n") * F.col("columns")) / F.sum("n"), 2)).alias("variance"),
    )
    return report.withColumn("stable", F.col("variance") < 0.25)


def image_report(images: DataFrame, page_counts: DataFrame, least: int = IMAGE_PIXELS) -> DataFrame:
    """Per book: images, large ones, large ones a page, median area, heavily illustrated (0.8 a page)."""
    large = (F.col("w") >= least) & (F.col("h") >= least)
    area = F.col("w").cast("double") * F.col("h")
    sums = images.groupBy("book_id").agg(F.count(F.lit(1)).alias("images"), F.count_if(large).alias("large"), F.median(F.when(large, area)).alias("median_area"))
    sums = page_counts.join(sums, "book_id", "left").withColumns({"images": F.coalesce("images", F.lit(0)), "large": F.coalesce("large", F.lit(0))})
    per_page = F.col("large") / F.greatest("page_count", F.lit(1))
    return sums.withColumns({"per_page": per_page, "heavy": per_page >= 0.8})


def image_size(source_w, source_h, shown_w, shown_h):
    """Source pixels where known, else the size shown."""
    return F.coalesce(F.when(source_w.isNotNull() & source_h.isNotNull(), F.struct(source_w.alias("w"), source_h.alias("h"))), F.struct(F.abs(shown_w).alias("w"), F.abs(shown_h).alias("h")))


def kept_images(images: DataFrame) -> DataFrame:
    """Images of at least 100 x 100 pixels and 5000 encoded bytes."""
    return images.where((F.col("w") >= IMAGE_PIXELS) & (F.col("h") >= IMAGE_PIXELS) & (F.col("bytes") >= IMAGE_BYTES))


def without_shadows(glyphs: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Glyphs (book_id, page, seq, object_type, text, x0, top) but those drawn again at the place of a kept one.

    Whether a glyph is kept depends on the kept ones before it, so a page is gone through in order: pages are
    dealt to tasks and sorted, and a task holds the kept glyphs of one page at a time.
    """

    def through(batches):
        page, cells = None, {}
        for pdf in batches:
            keep = []
            for book, no, kind, text, x, y in zip(pdf["book_id"], pdf["page"], pdf["object_type"], pdf["text"], pdf["x0"], pdf["top"], strict=True):
                if (book, no) != page:
                    page, cells = (book, no), {}
                if kind != "char":
                    keep.append(True)
                    continue
                i, j = int(x // tolerance), int(y // tolerance)
                near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in cells.get((text, i + a, j + b), ()))
                new = not any(abs(x - px) <= tolerance and abs(y - py) <= tolerance for px, py in near)
                if new:
                    cells.setdefault((text, i, j), []).append((x, y))
                keep.append(new)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    return glyphs.repartition("book_id", "page").sortWithinPartitions("book_id", "page", "seq").mapInPandas(through, glyphs.schema)
