"""Chunks, reports, dictionaries, profiles, question sets and file digests as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import profiles as P
from folioscan.operators.ingest import CHUNK


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines. Blank lines are skipped; a line that does not fit the schema is an error."""
    return spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Rows of a report as JSON, one file a partition."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).write.text(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, file_sha256) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("file_sha256"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose digest differs from the one in ``known`` (path, file_sha256): reports on them are stale."""
    return files.join(known.withColumnRenamed("file_sha256", "known_sha256"), "path").where("file_sha256 <> known_sha256")


def words(spark: SparkSession, path: str) -> DataFrame:
    """(word): a word list, lower-cased."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, headings, text) of raw web pages: tags, scripts, styles and comments go."""
    bare = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(bare, r"(?i)</?(p|h[1-6]|div|li|ul|nav|article|br|tr)\b[^>]*>", "\n"), r"<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    heads = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>"), F.lit(2)), lambda h: F.regexp_replace(h, r"<[^>]*>", ""))
    return pages.select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), heads.alias("headings"), F.regexp_replace(text, r"\n\s*\n+", "\n").alias("text"))


def walked_outline(spark: SparkSession, nested: list, book_id: str) -> DataFrame:
    """(book_id, ord, title, level, pdf_index) of a nested outline: (title, page or None, children), depth first."""
    rows: list[tuple] = []

    def walk(entries, level):
        for title, page, children in entries:
            rows.append((book_id, len(rows), title, level, page))
            walk(children, level + 1)

    walk(nested, 1)
    return spark.createDataFrame(rows, "book_id string, ord long, title string, level int, pdf_index long")


def _text(spark: SparkSession, path: str) -> str:
    """A whole small file, by any path that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def _structured(text: str, path: str):
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def profile_paths(spark: SparkSession, directory: str) -> list[str]:
    """The profiles of a folder, sorted, each once."""
    found = set()
    for pattern in ("*.yaml", "*.yml", "*.json"):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select("path")
        found |= {r[0] for r in files.collect()}
    return sorted(found)


def load_profiles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Profiles from YAML or JSON files. An invalid one is an error that names its file."""
    out = []
    for path in paths:
        try:
            out.append(_structured(_text(spark, path), path))
            P.validated(out[-1])
        except (ValueError, TypeError) as e:
            raise ValueError(f"invalid profile {path.rsplit('/', 1)[-1]}: {e}") from e
    return P.frame(spark, out)


QUESTION = "id string, category string, question string, expected_pages array<int>, page_alternatives map<int,array<int>>, must_contain array<string>, must_contain_any array<array<string>>, must_not_hallucinate array<string>"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set from YAML or JSON: {"questions": [...]}. Unknown keys are an error."""
    rows = _structured(_text(spark, path), path)["questions"]
    names = [f.strip().split(" ")[0] for f in QUESTION.split(", ")]
    for row in rows:
        if set(row) - set(names):
            raise ValueError(f"unknown keys: {sorted(set(row) - set(names))}")
    empty = {"expected_pages": [], "page_alternatives": {}, "must_contain": [], "must_contain_any": [], "must_not_hallucinate": []}
    return spark.createDataFrame([tuple((empty | row).get(n) for n in names) for row in rows], QUESTION)


def load_calibration(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(passages, cases, digest of the file). Pages must be distinct and hold every case's pages."""
    import hashlib

    text = _text(spark, path)
    corpus = _structured(text, path)
    pages = [p["page"] for p in corpus["passages"]]
    if not pages or len(set(pages)) < len(pages):
        raise ValueError("pages are missing or repeat")
    if any(set(c.get("pages") or []) - set(pages) for c in corpus["cases"]):
        raise ValueError("a case's page is not in the corpus")
    passages = spark.createDataFrame([(p["page"], p["section"], p["text"]) for p in corpus["passages"]], "page int, section string, text string")
    cases = spark.createDataFrame([(k, c["question"], c.get("pages") or []) for k, c in enumerate(corpus["cases"])], "query_id long, question string, pages array<int>")
    return passages, cases, hashlib.sha256(text.encode()).hexdigest()
