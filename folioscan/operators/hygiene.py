"""Which files of a repository must not be committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T

# Names and endings of files with secrets, of books, and of what is derived from them.
SECRET_NAMES = ".env .netrc .npmrc .pypirc id_rsa id_dsa id_ecdsa id_ed25519 credentials.json secrets.json secrets.yaml secrets.yml".split()
SECRET_SUFFIXES = ".pem .key .p12 .pfx".split()
SECRET_DIRS = ".aws .ssh".split()
BOOK_SUFFIXES = ".pdf .epub .mobi .cbz .cbr .djvu".split()
DERIVED_SUFFIXES = ".jsonl".split()
DERIVED_DIRS = "chunks/ qdrant_storage/ .cache/ data/ books/".split()
FIXTURES, MOST_BYTES = "fixtures/", 1 << 20


def declared(sources: DataFrame) -> DataFrame:
    """(path): the paths under fixtures/ that a text names, bare of quotes and brackets."""
    words = sources.select(F.explode(F.split("text", r"\s+")).alias("word")).where(F.contains("word", F.lit(FIXTURES)))
    return words.select(F.btrim("word", F.lit("`'\"(),")).alias("path")).distinct()


def checked(files: DataFrame, allowed: DataFrame) -> DataFrame:
    """Files (path, bytes) with the first rule that they break; null for those that may be committed."""
    name, ending = F.lower(T.file_name(F.col("path"))), T.suffix(F.col("path"))
    folders = F.transform(F.split("path", "/"), lambda p: F.lower(p))
    folders = F.slice(folders, 1, F.size(folders) - 1)
    secret = name.isin(*SECRET_NAMES) | name.startswith(".env.") | ending.isin(*SECRET_SUFFIXES) | F.arrays_overlap(folders, F.array(*[F.lit(d) for d in SECRET_DIRS]))
    book = ending.isin(*BOOK_SUFFIXES)
    derived = ending.isin(*DERIVED_SUFFIXES)
    for d in DERIVED_DIRS:
        derived = derived | F.contains("path", F.lit(d))
    rows = files.join(allowed.withColumn("declared", F.lit(True)), "path", "left")
    problem = F.when(secret, "secret").when(book & ~F.startswith("path", F.lit(FIXTURES)), "book outside fixtures").when(book & F.col("declared").isNull(), "undeclared fixture")
    return rows.select("path", "bytes", problem.when(derived, "derived").when(F.col("bytes") > MOST_BYTES, "too large").alias("problem"))


def paths(spark: SparkSession, repository: str, staged: bool = False) -> DataFrame:
    """(path, bytes) of a git repository's staged or tracked files."""
    import os
    import subprocess

    how = ["diff", "--cached", "--name-only", "--diff-filter=ACMR", "-z"] if staged else ["ls-files", "-z"]
    found = [p for p in subprocess.run(["git", "-C", repository, *how], check=True, capture_output=True, text=True).stdout.split("\0") if p]

    def size(path: str) -> int:
        if staged:
            shown = subprocess.run(["git", "-C", repository, "cat-file", "-s", f":{path}"], capture_output=True, text=True)
            if shown.returncode == 0:
                return int(shown.stdout)
        full = os.path.join(repository, path)
        return os.path.getsize(full) if os.path.exists(full) else 0

    return spark.createDataFrame([(p, size(p)) for p in found], "path string, bytes long")
