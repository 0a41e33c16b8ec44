"""The whole diagnosis of books: text layer, outline, page map, repeated lines, columns, images, contents, route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators import layout, outline as O, pagemap, profiles as P, textlayer, toc as TOC
from folioscan.operators.ingest import page_texts
from folioscan.operators.search import small
from folioscan.sources.staging import staged


def probe(lines: DataFrame, page_counts: DataFrame, outline: DataFrame, images: DataFrame | None = None, fonts: DataFrame | None = None, profiles: DataFrame | None = None, route: str | None = None) -> DataFrame:
    """One nested row per book. The page map is measured before repeated lines are removed, since folios repeat too;
    tables of contents are asked only where no numbers were printed. ``lines`` are read several times: cache them.
    What is small and used several times is staged: sizes of pages, runs, repeated lines and entries of contents."""
    pages = staged(lines.groupBy("book_id", "pdf_index").agg(F.sum(F.length(F.regexp_replace("text", "\n", ""))).alias("char_count")), "pages")
    layer = textlayer.verdicts(pages, fonts, lines=lines)
    entries = O.outline_report(outline, page_counts)
    runs = staged(pagemap.offset_runs(pagemap.chosen_offsets(pagemap.offset_votes(lines))), "runs")
    maps = pagemap.page_map(runs, page_counts)
    masks = small(staged(layout.boilerplate(lines, page_counts), "masks"))
    toc = staged(TOC.toc_entries(lines, masks, page_counts), "toc")
    toc_maps = TOC.toc_page_map(TOC.located_titles(toc, lines, page_counts), page_counts)
    maps = TOC.with_toc_maps(maps, toc_maps)
    found = pagemap.used_runs(runs, maps).unionByName(toc_maps.select("book_id", F.lit("toc").alias("kind"), "pdf_start", "pdf_end", "page_offset", F.col("matched").alias("measured")))
    spans = found.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pdf_start", "pdf_end", "page_offset"))).alias("runs"))
    columns = layout.column_report(layout.page_columns(lines.join(layout.sampled_pages(pages.select("book_id", "pdf_index")), ["book_id", "pdf_index"], "left_semi")))
    patterns = masks.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("page_ratio", "masked", "zone", "example")), asc=False).alias("boilerplate"))
    if images is None:
        pictures = page_counts.select("book_id", F.lit(0).cast("long").alias("images"), F.lit(0).cast("long").alias("large"), F.lit(None).cast("double").alias("median_area"), F.lit(0.0).alias("per_page"), F.lit(False).alias("heavy"))
    else:
        pictures = layout.image_report(images, page_counts).drop("page_count")
    nest = lambda df, name: df.select("book_id", F.struct(*[c for c in df.columns if c != "book_id"]).alias(name))
    out = page_counts
    for df, name in ((layer.drop("page_count"), "text_layer"), (entries, "outline"), (maps.drop("page_count"), "page_map"), (columns, "columns"), (pictures, "images"), (TOC.toc_report(toc), "toc")):
        out = out.join(nest(df, name), "book_id", "left")
    out = out.join(spans, "book_id", "left").join(patterns, "book_id", "left").join(textlayer.fingerprints(page_texts(lines)).drop("pdf_index"), "book_id", "left")
    choice = textlayer.routes(out.select("book_id", "text_layer.verdict", "outline.usable", "images.heavy"))
    out = out.join(choice, "book_id")
    if profiles is not None:
        own = out.withColumns({c: F.lit(None).cast("string") for c in ("producer", "file_sha256") if c not in out.columns})
        out = P.applied(own, profiles)
    return out.withColumn("route", F.lit(route)) if route is not None else out


def shown(report: dict, errors: list[str] = ()) -> str:
    """A probe's row as text for a terminal: at most 8 repeated lines, 6 runs, 4 titles and 20 errors (``errors``: texts)."""
    lines = [f"{report['book_id']}: {report['page_count']} pages, route {report['route']}"]
    layer, pages = report["text_layer"], report["page_map"]
    lines.append(f"text: {layer['verdict']} {', '.join(layer['reasons'])}".rstrip())
    lines.append(f"outline: {report['outline']['entries']} entries, usable: {report['outline']['usable']}")
    lines.append(f"pages: {pages['method']} ({pages['source']}), confidence {pages['confidence']:.2f}")
    lines += [f"  {r['pdf_start']}-{r['pdf_end']}: offset {r['page_offset']}" for r in (report["runs"] or [])[:6]]
    lines += [f"  {b['page_ratio']:.0%} {b['zone']}: {b['example']}" for b in (report["boilerplate"] or [])[:8]]
    if report["columns"]:
        lines.append(f"columns: {report['columns']['dominant']}, {'stable' if report['columns']['stable'] else 'changing'}")
    if report["images"]:
        lines.append(f"images: {report['images']['images']}, large: {report['images']['large']}, heavy: {report['images']['heavy']}")
    if report["toc"]:
        lines.append(f"contents: {report['toc']['entry_count']} entries")
        lines += [f"  {s}" for s in report["toc"]["sample"][:4]]
    if errors:
        lines.append(f"errors: {len(errors)}")
        lines += [f"  {e}" for e in errors[:20]]
    return "\n".join(lines)
