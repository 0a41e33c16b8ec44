"""The driver's tables as books, pages, lines, questions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.operators import ingest

#: Ranges of ids in which the pages of a book are numbered.
RANGES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir) -> DataFrame:
    """(book_id, doc_id, text): the documents of each source, for what needs no page numbers."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def pages(spark, sf_dir) -> DataFrame:
    """(book_id, pdf_index, doc_id, text): a source is a book, its documents are the pages in order of their ids.

    A book may be a large share of all texts, so each is numbered in ranges of ids, and the pages of the ranges before
    are added: a window of few rows without texts. A struct as the key takes null for a source like others.
    """
    docs = texts(spark, sf_dir)
    bounds = docs.agg(F.percentile_approx("doc_id", [k / RANGES for k in range(1, RANGES)])).first()[0] or []
    place = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    ranged = docs.withColumn("at", F.struct("book_id", place.alias("place")))
    own = Window.partitionBy("at.book_id").orderBy("at.place").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("at").agg(F.count(F.lit(1)).alias("n")).select("at", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("at").orderBy("doc_id")) - 1
    return ranged.withColumn("nth", nth).join(before, "at").select("book_id", (F.col("nth") + F.col("before")).cast("long").alias("pdf_index"), "doc_id", "text")


def page_counts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("book_id")).agg(F.count(F.lit(1)).alias("page_count"))


def lines(spark, sf_dir) -> DataFrame:
    """Lines of the pages, placed evenly down a page of 800 points, with starts in one or two columns by their number."""
    made = ingest.lines_of(pages(spark, sf_dir))
    return made.withColumn("x0", F.when((F.col("pdf_index") % 2 == 1) & (F.col("line_no") % 2 == 1), 320.0).otherwise(60.0))


def numbered_lines(spark, sf_dir) -> DataFrame:
    """Lines of made-up books, one for each customer nation: a page for each order, in order of its key, with a folio
    in its footer (page + 1, or + 3 from the 40th page on), a footer with other numbers, and a body line."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    own = Window.partitionBy("c_nationkey").orderBy("o_orderkey")
    page = o.join(c, o.o_custkey == c.c_custkey).select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("book_id"), (F.row_number().over(own) - 1).cast("long").alias("pdf_index"), "o_orderkey", "o_custkey")
    printed = F.when(F.col("pdf_index") < 40, F.col("pdf_index") + 1).otherwise(F.col("pdf_index") - 3)
    # Every seventh page has no folio; a page of key 5 modulo 11 has another number in its place.
    folio = F.when(F.col("o_orderkey") % 11 == 5, F.col("o_orderkey") % 900 + 1).otherwise(printed)
    rows = F.array(
        F.struct(F.lit(0).alias("line_no"), F.lit(20.0).alias("top"), F.concat(F.lit("Layout 7 Page "), (F.col("pdf_index") + 3).cast("string")).alias("text")),
        F.struct(F.lit(1).alias("line_no"), F.lit(300.0).alias("top"), F.concat(F.lit("body of customer "), F.col("o_custkey").cast("string")).alias("text")),
        F.struct(F.lit(2).alias("line_no"), F.lit(760.0).alias("top"), F.when(F.col("pdf_index") % 7 != 6, folio.cast("string")).otherwise(F.lit("-")).alias("text")),
    )
    out = page.select("book_id", "pdf_index", F.explode(rows).alias("l")).select("book_id", "pdf_index", "l.line_no", "l.text", "l.top")
    return out.withColumns({"bottom": F.col("top") + 10, "x0": F.lit(60.0), "width": F.lit(600.0), "height": F.lit(800.0)})


def questions(spark, sf_dir) -> DataFrame:
    """(query_id, question): the benchmark's items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def chunks(spark, sf_dir) -> DataFrame:
    """Every document as one chunk of its source, with one page."""
    p = pages(spark, sf_dir)
    page = F.struct((F.col("pdf_index") + 1).cast("int").alias("pdf_page"), (F.col("pdf_index") + 1).cast("int").alias("book_page"), "text")
    return p.select(F.col("doc_id").alias("id"), "book_id", F.col("book_id").alias("section_path"), "text", F.array(page).alias("pages"))


def question_vectors(spark, sf_dir) -> DataFrame:
    """A question's vector is the stored one of its own number."""
    q, v = questions(spark, sf_dir), table(spark, sf_dir, "embeddings")
    return q.join(v, q.query_id == v.vec_id).select("query_id", F.col("embedding").alias("vector"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def outline(spark, sf_dir) -> DataFrame:
    """(book_id, ord, title, level, pdf_index): of each region a book; nations are parts, their suppliers chapters and
    each third of them, from the second, a section of the one before."""
    n, s, r = (table(spark, sf_dir, x) for x in ("nation", "supplier", "region"))
    own = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    chapters = s.withColumn("nth", F.row_number().over(own)).join(n, s.s_nationkey == n.n_nationkey)
    parts = n.select(F.col("n_regionkey").alias("k"), (F.col("n_nationkey").cast("long") * 1_000_000).alias("o"), F.col("n_name").alias("title"), F.lit(1).alias("level"))
    below = chapters.select(F.col("n_regionkey"), F.col("s_nationkey").cast("long") * 1_000_000 + F.col("nth"), F.col("s_name"), F.when(F.col("nth") % 3 == 2, 3).otherwise(2))
    rows = parts.unionByName(below.toDF("k", "o", "title", "level")).join(r, F.col("k") == r.r_regionkey)
    return rows.select(F.col("r_name").alias("book_id"), F.col("o").cast("long").alias("ord"), "title", "level", F.col("o").cast("long").alias("pdf_index"))
