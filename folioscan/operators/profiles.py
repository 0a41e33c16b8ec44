"""Profiles of books: what they match, what they override, and their files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILE = (
    "name string, page_count int, producer_contains string, first_page_text_sha256 string, file_sha256 string, route string, reading_order string, page_offset int, "
    "boilerplate_patterns array<string>, drop_sections array<string>, table_pages array<int>, heading_overrides map<string,struct<text:string,occurrence:int>>, notes string"
)
_MATCH = ("page_count", "producer_contains", "first_page_text_sha256", "file_sha256")
_TOP = ("name", "match", "route", "reading_order", "page_offset", "boilerplate_patterns", "drop_sections", "table_pages", "heading_overrides", "notes")


def validated(profile: dict) -> dict:
    """A profile as a row of PROFILE. Other keys, criteria that do not identify a book, broken patterns and
    pages below 1 are errors."""
    match = profile.get("match") or {}
    if set(profile) - set(_TOP) or set(match) - set(_MATCH) or not profile.get("name"):
        raise ValueError(f"unknown or missing keys: {sorted((set(profile) - set(_TOP)) | (set(match) - set(_MATCH)))}")
    if not (match.get("first_page_text_sha256") or match.get("file_sha256") or (match.get("page_count") and match.get("producer_contains"))):
        raise ValueError("a match needs a fingerprint, or pages and producer")
    for k in ("first_page_text_sha256", "file_sha256"):
        if match.get(k) is not None and not re.fullmatch("[a-f0-9]{64}", match[k]):
            raise ValueError(f"{k} is no digest")
    for pattern in profile.get("boilerplate_patterns") or []:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"invalid pattern: {e}") from e
    if any(p < 1 for p in profile.get("table_pages") or []):
        raise ValueError("table_pages are printed pages from 1")
    if profile.get("route") not in (None, "A", "B", "C", "D") or profile.get("reading_order") not in (None, "text_flow", "position"):
        raise ValueError("unknown route or reading order")
    out = {k: match.get(k) for k in _MATCH} | {k: profile.get(k) for k in _TOP if k != "match"}
    for k in ("boilerplate_patterns", "drop_sections", "table_pages"):
        out[k] = out[k] or []
    out["heading_overrides"] = {k: (v["text"], v.get("occurrence", 1)) for k, v in (out["heading_overrides"] or {}).items()}
    if any(not t or n < 1 for t, n in out["heading_overrides"].values()):
        raise ValueError("a heading needs a text and an occurrence from 1")
    out["notes"] = out["notes"] or ""
    return out


def frame(spark, profiles: list[dict]) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in re.split(r",\s*(?=\w+ (?:string|int|array|map))", PROFILE)]
    return spark.createDataFrame([tuple(validated(p)[n] for n in names) for p in profiles], PROFILE)


def matches(reports: DataFrame, profiles: DataFrame) -> DataFrame:
    """(book_id, name): all given criteria hold. Profiles with a digest are found by an equi-join on it; the
    few by pages and producer by an equi-join on pages."""
    same = lambda c: F.col(f"p.{c}").isNull() | (F.col(f"p.{c}") == F.col(f"r.{c}"))
    producer = F.col("p.producer_contains").isNull() | F.contains(F.coalesce("r.producer", F.lit("")), F.col("p.producer_contains"))
    whole = same("page_count") & producer & same("first_page_text_sha256") & same("file_sha256")
    r = reports.alias("r")
    found = None
    for key, only in (("file_sha256", "true"), ("first_page_text_sha256", "file_sha256 is null"), ("page_count", "file_sha256 is null and first_page_text_sha256 is null")):
        own = profiles.where(f"{key} is not null and {only}").alias("p")
        met = r.join(own, F.col(f"r.{key}") == F.col(f"p.{key}")).where(whole).select("r.book_id", "p.name")
        found = met if found is None else found.unionByName(met)
    return found


def applied(reports: DataFrame, profiles: DataFrame) -> DataFrame:
    """Reports with the profile's values in place of their own. Several matches of one book are an error."""
    one = matches(reports, profiles).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("profile"))
    one = one.where(F.when(F.col("n") > 1, F.raise_error(F.lit("several profiles match"))).otherwise(F.lit(True))).drop("n")
    fields = profiles.select(F.col("name").alias("profile"), F.col("route").alias("_route"), "reading_order", F.col("page_offset").alias("profile_offset"), "drop_sections", "table_pages", "boilerplate_patterns", "heading_overrides")
    rows = reports.join(one, "book_id", "left").join(fields, "profile", "left")
    return rows.withColumn("route", F.coalesce("_route", "route")).drop("_route")


def template(report: dict, name: str) -> str:
    """A profile to begin with, as YAML: identity by the text's fingerprint, else by the file's; no page offset."""
    lines = [f"name: {name}", "match:"]
    if report.get("page_count"):
        lines.append(f"  page_count: {report['page_count']}")
    if report.get("first_page_text_sha256"):
        lines.append(f"  first_page_text_sha256: {report['first_page_text_sha256']}")
    elif report.get("file_sha256"):
        lines.append(f"  file_sha256: {report['file_sha256']}")
    lines += ["boilerplate_patterns: []", "drop_sections: []", "table_pages: []", "heading_overrides: {}", 'notes: ""']
    return "\n".join(lines) + "\n"
