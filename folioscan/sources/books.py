"""Books as a parser leaves them: a folder of tables of one or more books, each as Parquet or as JSON lines.

``lines`` and ``outline`` must be there; ``images``, ``fonts`` and ``errors`` may be missing, which is not the same as
being empty: without ``fonts`` nothing is said of fonts, with it a book that has none there has none. A page that a
parser could not read has a row in ``errors`` and still counts as a page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "book_id string, pdf_index long, line_no int, text string, x0 double, top double, bottom double, width double, height double"
OUTLINE = "book_id string, ord long, title string, level int, pdf_index long"
IMAGES = "book_id string, pdf_index long, w double, h double, bytes long"
FONTS = "book_id string, pdf_index long, font string, embedded boolean"
ERRORS = "book_id string, pdf_index long, problem string"


@dataclass(frozen=True)
class Books:
    lines: DataFrame
    outline: DataFrame
    images: DataFrame | None = None
    fonts: DataFrame | None = None
    errors: DataFrame | None = None

    @property
    def page_counts(self) -> DataFrame:
        """(book_id, page_count), by the last page of which anything is known."""
        known = [t.select("book_id", "pdf_index") for t in (self.lines, self.images, self.errors) if t is not None]
        every = known[0]
        for other in known[1:]:
            every = every.unionByName(other)
        return every.groupBy("book_id").agg((F.max("pdf_index") + 1).alias("page_count"))

    @property
    def digests(self) -> DataFrame:
        """(book_id, file_sha256): a digest of a book's lines, whatever their order."""
        line = F.xxhash64("pdf_index", "line_no", "text").cast("decimal(38,0)")
        return self.lines.groupBy("book_id").agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(line).cast("string")), 256).alias("file_sha256"))


def table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame | None:
    """``path``/name as Parquet, or ``path``/name.jsonl; none if there is neither. A line that does not fit is an error."""
    tries = (lambda: spark.read.parquet(f"{path}/{name}"), lambda: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}.jsonl"))
    for read in tries:
        try:
            return read()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def read_books(spark: SparkSession, path: str) -> Books:
    lines, outline = table(spark, path, "lines", LINES), table(spark, path, "outline", OUTLINE)
    if lines is None or outline is None:
        raise ValueError(f"no lines or no outline in {path}")
    return Books(lines, outline, *(table(spark, path, n, s) for n, s in (("images", IMAGES), ("fonts", FONTS), ("errors", ERRORS))))
