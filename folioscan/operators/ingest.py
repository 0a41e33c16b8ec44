"""From lines and an outline to chunks: the whole ingestion of books with native text and a usable outline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import chunking, layout, outline as O, pagemap
from folioscan.operators.search import small
from folioscan.sources.staging import staged

CHUNK = (
    "id string, book_id string, section_path string, text string, raw_text string, book_page int, pdf_page int, "
    f"pages {chunking.PAGES}, type string, images array<string>, route string"
)


def preconditions(outline: DataFrame, page_counts: DataFrame, reports: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """(book_id, problem): what keeps a book from being ingested. Nothing is repaired."""
    held = outline.join(page_counts, "book_id")
    found = held.where("pdf_index is null").select("book_id", F.lit("an entry has no destination").alias("problem"))
    found = found.union(held.where("pdf_index < 0 or pdf_index >= page_count").select("book_id", F.lit("a destination is outside the book")))
    found = found.union(O.level_jumps(outline).select("book_id", F.lit("a level is skipped")))
    if reports is not None:
        found = found.union(reports.where("route <> 'A'").select("book_id", F.lit("only route A is ingested")))
    if errors is not None:
        found = found.union(errors.select("book_id", F.lit("pages could not be read")))
    return found.distinct()


def sections(lines: DataFrame, anchored: DataFrame, printed: DataFrame, maps: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(book_id, section_no, section_path, pages): the text of each section by page, without its heading line.

    Printed pages that were only guessed, by numbering or from numbers inside lines, are null.
    """
    rows = O.lines_of_sections(lines, anchored).where("section is not null").select("*", "section.section_no", "section.section_path", "section.found", "section.heading_line", "section.heading_page")
    rows = rows.where(~(F.col("found") & (F.col("pdf_index") == F.col("heading_page")) & (F.col("line_no") == F.col("heading_line"))))
    if dropped is not None:
        rows = O.without_sections(rows, dropped)
    measured = maps.select("book_id", (~((F.col("method") == "identity") | (F.col("source") == "embedded"))).alias("measured"))
    rows = rows.join(printed, ["book_id", "pdf_index"], "left").join(measured, "book_id", "left")
    page = rows.groupBy("book_id", "section_no", "section_path", "pdf_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", T.strip(F.col("text")).alias("text")))), lambda x: x["text"]), "\n").alias("text"),
        F.max(F.when(F.col("measured"), F.col("book_page"))).cast("int").alias("book_page"),
    )
    page = page.where(F.length(T.strip(F.col("text"))) > 0)
    pages = F.array_sort(F.collect_list(F.struct((F.col("pdf_index") + 1).cast("int").alias("pdf_page"), "book_page", "text")))
    return page.groupBy("book_id", "section_no", "section_path").agg(pages.alias("pages"))


def chunk_rows(parts: DataFrame, files: DataFrame, table_pages: DataFrame | None = None) -> DataFrame:
    """Chunks with all their fields. ``files``: (book_id, file_sha256); ``table_pages``: (book_id, pages)."""
    raw = F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n")
    rows = parts.where("error is null").join(files, "book_id").withColumn("raw_text", raw)
    if table_pages is not None:
        rows = rows.join(table_pages.withColumnRenamed("pages", "table_pages"), "book_id", "left")
        table = F.coalesce(F.arrays_overlap(F.array_compact(F.transform("pages", lambda p: p["book_page"])), "table_pages"), F.lit(False))
    else:
        table = F.lit(False)
    return rows.select(
        chunking.chunk_id(F.col("file_sha256"), F.col("section_no"), F.col("part"), F.col("raw_text")).alias("id"), "book_id", "section_path",
        F.concat(F.col("section_path"), F.lit("\n\n"), F.col("raw_text")).alias("text"), "raw_text",
        F.col("pages")[0]["book_page"].alias("book_page"), F.col("pages")[0]["pdf_page"].alias("pdf_page"), "pages",
        F.when(table, "table").otherwise("text").alias("type"), F.array().cast("array<string>").alias("images"), F.lit("A").alias("route"),
    )


def ingest(lines: DataFrame, outline: DataFrame, page_counts: DataFrame, files: DataFrame, max_tokens: int = chunking.BUDGET, overrides=None, dropped=None, table_pages=None, regexes=(), offsets: DataFrame | None = None) -> DataFrame:
    """All steps: page map, boilerplate, folios, anchors, sections, chunks. ``offsets``: (book_id, page_offset) of profiles."""
    runs = staged(pagemap.offset_runs(pagemap.chosen_offsets(pagemap.offset_votes(lines))), "runs")
    maps = pagemap.page_map(runs, page_counts)
    used = pagemap.used_runs(runs, maps).select("book_id", "pdf_start", "pdf_end", "page_offset")
    if offsets is not None:
        own = pagemap.profile_map(page_counts.join(offsets, "book_id"))
        used = used.join(own, "book_id", "left_anti").unionByName(own)
        maps = maps.join(own.select("book_id", F.lit(True).alias("own")), "book_id", "left").withColumns({"method": F.when(F.col("own"), "profile").otherwise(F.col("method")), "source": F.when(F.col("own"), "profile").otherwise(F.col("source"))}).drop("own")
    pages = lines.select("book_id", "pdf_index").distinct()
    printed = pagemap.printed_pages(pages, used, maps)
    patterns = small(staged(layout.boilerplate(lines, page_counts), "patterns"))
    # Dealt by page once: what follows joins and sums up by page.
    lines = lines.select("book_id", "pdf_index", "line_no", "text", "top", "bottom", "height").repartition("book_id", "pdf_index")
    body = layout.without_folios(layout.without_boilerplate(lines, patterns, regexes), printed, maps)
    # Headings are looked for in all lines, as a repeated heading is still a heading.
    anchored = O.anchors(O.section_paths(outline), body, overrides)
    return chunk_rows(chunking.section_chunks(sections(body, anchored, printed, maps, dropped), max_tokens), files, table_pages)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, distinct sections, and estimated tokens: least, median, most, and how many in each of five ranges."""
    size = T.estimated_tokens(F.col("text"))
    bucket = lambda low, high: F.count_if((F.col("size") > low) & (F.col("size") <= high))
    return chunks.select("book_id", "section_path", size.alias("size")).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("section_path").alias("sections"), F.min("size").alias("min_tokens"), F.median("size").alias("median_tokens"), F.max("size").alias("max_tokens"),
        bucket(-1, 300).alias("le_300"), bucket(300, 600).alias("le_600"), bucket(600, 900).alias("le_900"), bucket(900, 1200).alias("le_1200"), F.count_if(F.col("size") > 1200).alias("gt_1200"),
    )


def lines_of(pages: DataFrame) -> DataFrame:
    """Lines (stripped, none empty) of pages (book_id, pdf_index, text), placed down a page of 600 x 800."""
    rows = pages.select("book_id", "pdf_index", F.posexplode(F.split("text", "\n")).alias("line_no", "text"), F.size(F.split("text", "\n")).alias("n"))
    top = F.lit(20.0) + F.lit(760.0) * F.col("line_no") / F.col("n")
    rows = rows.withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    return rows.select("book_id", "pdf_index", "line_no", "text", F.lit(60.0).alias("x0"), F.lit(540.0).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


def page_texts(lines: DataFrame) -> DataFrame:
    """(book_id, pdf_index, text): lines joined again."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("book_id", "pdf_index").agg(joined.alias("text"))


