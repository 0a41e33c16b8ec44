"""Column functions on lines and texts. Patterns use (?U): letters, digits and spaces of all of Unicode."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

# What the patterns below must recognise.
TOC_PAIR = r"(?U)([^\W\d_][^\d\n]{2,70}?)\s*[.·•‧∙…\-_ ]{1,}(\d{1,4})(?=\s|$)"
#: The number that ends such a pair, with all that can stand between it and the title, and the longest title.
TOC_NUMBER, TOC_LEADER, TOC_TITLE = r"(?U)[.·•‧∙…\-_ ]\d{1,4}$", r"(?U)[\s.·•‧∙…\-_]*+\d{1,4}$", 71
PAGE_REFERENCE = r"(?iU)\(?\s*\b(?:p{1,2}\.?|pages?)\s*(\d+(?:\s*(?:[-–—,;/]|et|and|à|to)\s*\d+)*)\s*\)?"
NUMERIC = r"(?U)(?<!\w)[+-]?\d+(?:[.,]\d+)?%?"
CITATION = r"(?U)\(p\.\s*(\d+)\)"
INTEGER = r"(?U)\b\d{1,4}\b"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """All runs of white space as one space, none at the ends."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def mask_line(c: Column) -> Column:
    """The form by which repeated lines are counted: lower case, single spaces, numbers as #."""
    return F.regexp_replace(F.lower(squeeze(c)), r"(?U)\d+", "#")


def _folded(x):
    """NFKC, case-folded, single spaces, of a text or of all texts of an array."""
    if x is None:
        return None
    if isinstance(x, str):
        return " ".join(unicodedata.normalize("NFKC", x).casefold().split())
    return [_folded(y) for y in x]


def _folding(kind: DataType):
    @F.pandas_udf(kind)
    def fold(s: pd.Series) -> pd.Series:
        return s.map(_folded)

    return fold


def title_key(c: Column) -> Column:
    """What headings, and answers with the terms they must hold, are compared by. Spark has no such normal form."""
    return _folding(StringType())(c)


def title_keys(c: Column, depth: int = 1) -> Column:
    """title_key() of an array of texts, or with ``depth`` 2 of an array of arrays."""
    kind: DataType = StringType()
    for _ in range(depth):
        kind = ArrayType(kind)
    return _folding(kind)(c)


def contains_word(text: Column, term: Column) -> Column:
    """Whether the term stands in the text with no letter or digit at its sides."""
    return F.rlike(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), term, F.lit(r"\E(?!\w)")))


def sentences(c: Column) -> Column:
    return F.split(squeeze(c), r"(?<=[.!?])\s+")


def estimated_tokens(c: Column) -> Column:
    """Three bytes of UTF-8 a token, rounded up."""
    return F.ceil(F.octet_length(c) / 3).cast("long")


def is_heading(c: Column) -> Column:
    """An upper-case line of at most 120 characters that has a letter."""
    line = strip(c)
    return (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) <= 120)


def terms(c: Column) -> Column:
    """Search terms: runs of word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def quality_tokens(c: Column) -> Column:
    """Runs of word characters, apostrophes and hyphens that hold a letter."""
    return F.filter(F.split(c, r"(?U)[^\w'-]+"), lambda t: t.rlike(r"\p{L}"))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMERIC), F.lit(0))


def integers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(INTEGER), F.lit(0)), lambda x: x.cast("int"))


def cited_pages(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int")))


def referenced_pages(c: Column) -> Column:
    """Every number of every page reference such as ``p. 3`` or ``pages 4 and 5``."""
    spans = F.regexp_extract_all(c, F.lit(PAGE_REFERENCE), F.lit(1))
    return F.flatten(F.transform(spans, lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))))


def toc_pairs(c: Column) -> Column:
    """(title, page) pairs of a line of a table of contents.

    No pair holds a digit but its number, so a text is cut behind its numbers, and of each part that ends in a pair's
    number only what a title and its leader can take is searched: TOC_PAIR tries every letter as a title's first.
    """
    parts = F.filter(F.split(c, r"(?U)(?<=\d)(?=\s|$)"), lambda p: p.rlike(TOC_NUMBER))
    tails = F.transform(parts, lambda p: F.right(p, F.length(F.regexp_extract(p, TOC_LEADER, 0)) + TOC_TITLE))
    found = F.transform(tails, lambda t: F.struct(F.regexp_extract(t, TOC_PAIR, 1).alias("t"), F.regexp_extract(t, TOC_PAIR, 2).alias("p")))
    return F.transform(F.filter(found, lambda x: x["t"] != ""), lambda x: F.struct(strip(x["t"]).alias("title"), x["p"].cast("int").alias("page")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def suffix(path: Column) -> Column:
    """The lower-cased last extension of a path's file name, with its dot; none for names that begin with it."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
