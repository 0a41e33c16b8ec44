"""Outlines: usability, section paths, anchors on pages, and the sections of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T

LEAST_ENTRIES, LEAST_RESOLVED, MOST_SPAN, LEAST_COVERAGE = 10, 0.8, 30, 0.80


def outline_spans(outline: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(book_id, start, span): distinct resolved starts of a book and the pages up to the next or the end."""
    starts = outline.where("pdf_index is not null").select("book_id", "pdf_index").distinct().join(page_counts, "book_id")
    after = F.lead("pdf_index").over(Window.partitionBy("book_id").orderBy("pdf_index"))
    return starts.select("book_id", F.col("pdf_index").alias("start"), (F.coalesce(after, F.col("page_count")) - F.col("pdf_index")).alias("span"))


def outline_report(outline: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Per book: entries, resolved, median and largest span, largest gap, coverage, usable, reasons."""
    spans = outline_spans(outline, page_counts).groupBy("book_id").agg(F.median("span").alias("median_span"), F.max("span").alias("max_span"), F.min("start").alias("first"))
    counts = outline.groupBy("book_id").agg(F.count(F.lit(1)).alias("entries"), F.count("pdf_index").alias("resolved"))
    all_ = page_counts.join(counts, "book_id", "left").join(spans, "book_id", "left").fillna({"entries": 0, "resolved": 0})
    pages = F.col("page_count")
    coverage = F.when(pages > 0, (pages - F.col("first")) / pages)
    reasons = F.array_compact(F.array(
        F.when(F.col("entries") < F.least(F.lit(LEAST_ENTRIES), pages), "few entries"),
        F.when((F.col("entries") > 0) & (F.col("resolved") / F.greatest("entries", F.lit(1)) < LEAST_RESOLVED), "unresolved entries"),
        F.when(F.col("median_span") > MOST_SPAN, "wide sections"),
        F.when(coverage < LEAST_COVERAGE, "low coverage"),
    ))
    return all_.select("book_id", "entries", "resolved", "median_span", "max_span", F.greatest("max_span", "first").alias("largest_gap"), coverage.alias("coverage"), (F.size(reasons) == 0).alias("usable"), reasons.alias("reasons"))


def level_jumps(outline: DataFrame) -> DataFrame:
    """Entries whose level is more than one below the entry before them: their paths would be undefined."""
    before = F.coalesce(F.lag("level").over(Window.partitionBy("book_id").orderBy("ord")), F.lit(0))
    return outline.withColumn("before", before).where(F.col("level") > F.col("before") + 1)


def section_paths(outline: DataFrame, separator: str = " > ") -> DataFrame:
    """The outline with section_path, the titles above an entry and its own.

    Ancestors follow without recursion: of the entries above level l only the last one before an entry can
    be its ancestor at l, and only if no entry of a smaller level came between. A window keeps, for each
    level, the last entry, and drops those that are older than the last entry of a level above. There are as
    many levels as the outline has, which is counted first.
    """
    deepest = max(outline.agg(F.max("level")).first()[0] or 1, 1)
    along = Window.partitionBy("book_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = outline
    for level in range(1, deepest + 1):
        out = out.withColumn(f"_{level}", F.last(F.when(F.col("level") == level, F.struct("ord", "title")), ignorenulls=True).over(along))
    names = []
    for level in range(1, deepest + 1):
        above = [F.coalesce(F.col(f"_{k}.ord"), F.lit(-1)) for k in range(1, level)]
        fresh = F.col(f"_{level}.ord") > F.greatest(F.lit(-1), *above) if level > 1 else F.col(f"_{level}").isNotNull()
        names.append(F.when((F.lit(level) <= F.col("level")) & fresh, F.col(f"_{level}.title")))
    path = F.array_join(F.array_compact(F.array(*names)), separator)
    return out.withColumn("section_path", path).drop(*[f"_{k}" for k in range(1, deepest + 1)])


def anchors(outline: DataFrame, lines: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The outline with the line of its destination page that is its heading.

    Adds line_no (0, the top of the page, without a match), matches and problem: several equal lines without a
    profile's choice, or none although another entry of the page could be meant. ``overrides``: (book_id,
    title_key, text, occurrence).
    """
    wanted = outline.withColumn("title_key", T.title_key(F.col("title")))
    if overrides is not None:
        wanted = wanted.join(overrides, ["book_id", "title_key"], "left")
        key = F.coalesce(T.title_key(F.col("text")), F.col("title_key"))
        wanted = wanted.withColumn("key", key).drop("text")
    else:
        wanted = wanted.withColumns({"key": F.col("title_key"), "occurrence": F.lit(None).cast("int")})
    own = lines.select("book_id", "pdf_index", F.col("line_no").alias("at"), T.title_key(F.col("text")).alias("key"))
    met = wanted.join(own, ["book_id", "pdf_index", "key"], "left")
    per_entry = Window.partitionBy("book_id", "ord")
    met = met.withColumns({"nth": F.row_number().over(per_entry.orderBy("at")), "matches": F.count("at").over(per_entry)})
    chosen = met.where(F.col("nth") == F.when(F.col("occurrence") <= F.col("matches"), F.col("occurrence")).otherwise(1))
    same_page = Window.partitionBy("book_id", "pdf_index").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    later = F.coalesce(F.min("level").over(same_page) <= F.col("level"), F.lit(False))
    problem = F.when((F.col("matches") > 1) & F.col("occurrence").isNull(), "ambiguous").when(F.col("occurrence") > F.col("matches"), "no such occurrence").when((F.col("matches") == 0) & later, "not found")
    return chosen.select(*outline.columns, F.coalesce("at", F.lit(0)).alias("line_no"), F.col("at").isNotNull().alias("found"), "matches", problem.alias("problem"))


def section_bounds(anchored: DataFrame) -> DataFrame:
    """Anchors in page order with the place where the next one begins (null for a book's last)."""
    along = Window.partitionBy("book_id").orderBy("pdf_index", "line_no", "ord")
    return anchored.withColumns({"section_no": F.row_number().over(along), "next_page": F.lead("pdf_index").over(along), "next_line": F.lead("line_no").over(along)})


def lines_of_sections(lines: DataFrame, anchored: DataFrame) -> DataFrame:
    """Lines with the section that was opened last before them: an as-of join by one sort of each book."""
    marks = section_bounds(anchored).select("book_id", "pdf_index", "line_no", F.lit(0).alias("kind"), F.struct("section_no", "section_path", "title", "found", F.col("line_no").alias("heading_line"), F.col("pdf_index").alias("heading_page")).alias("section"))
    rows = lines.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    along = Window.partitionBy("book_id").orderBy("pdf_index", "line_no", "kind", F.col("section.section_no")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last("section", ignorenulls=True).over(along)).where("kind = 1").drop("kind")


def without_sections(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows but those with a dropped title (book_id, title) anywhere in their section_path. Bounds stay as they were."""
    parts = rows.withColumn("part", F.explode(F.split("section_path", " > "))).withColumn("key", T.title_key(F.col("part")))
    gone = dropped.select("book_id", T.title_key(F.col("title")).alias("key")).distinct()
    bad = parts.join(gone, ["book_id", "key"], "left_semi").select("book_id", "section_path").distinct()
    return rows.join(bad, ["book_id", "section_path"], "left_anti")
