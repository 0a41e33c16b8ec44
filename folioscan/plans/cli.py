"""Command line: python -m folioscan.plans.cli COMMAND. Books are folders of tables, as in sources/books.py."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscan.operators import hygiene, ingest, probe, profiles, search, textlayer
from folioscan.plans import asking
from folioscan.sources import books, files
from folioscan.sources.staging import shared_path

VERSION = "0.1.0"


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _profiles(spark, args):
    """The profile that is named, else those of a folder, else none."""
    paths = [args.profile] if args.profile else files.profile_paths(spark, args.profiles_dir) if args.profiles_dir else []
    return files.load_profiles(spark, paths) if paths else None


def _report(spark, args, book):
    fonts = None if book.fonts is None else textlayer.embedded_fonts(book.fonts)
    return probe.probe(book.lines.cache(), book.page_counts, book.outline, book.images, fonts, _profiles(spark, args), args.route)


def _shown(hit) -> str:
    own = {"rank": hit["rank"], "section": hit["section_path"], "page": hit["book_page"], "pdf_page": hit["pdf_page"], "score": hit["score"], "text": hit["text"]}
    return json.dumps(own | {x: hit[x] for x in ("bm25_rank", "dense_rank", "rrf")}, ensure_ascii=False)


def _asked(book: asking.Book, question: str, args, history: list[tuple[str, str]] = ()) -> str:
    """Prints hits where they are asked for or all there is; returns the answer."""
    spark = book.spark
    asked = spark.createDataFrame([(0, question)], "query_id long, question string")
    # A handful of rows, of which prompt, check and print each need all.
    found = book.hits(asked, args.threshold, args.top_k).orderBy("rank")
    hits = spark.createDataFrame(found.collect(), found.schema)
    if args.debug or book.models.answer is None:
        for hit in hits.collect():
            print(_shown(hit))
    if book.models.answer is None:
        return "" if hits.count() else asking.grounding.NOT_FOUND
    before = spark.createDataFrame([(0, list(history)[-asking.TURNS :])], f"query_id long, history {asking.HISTORY}")
    told = book.answers(asked, hits, before).first()
    if told["error"]:
        raise RuntimeError(told["error"])
    return told["answer"]


def _conversation(book: asking.Book, args) -> None:
    """Questions from standard input over one index. /history, /clear and /quit; the history lives as long as the session."""
    history: list[tuple[str, str]] = []
    for line in sys.stdin:
        question = line.strip()
        if question == "/quit":
            return
        if question == "/clear":
            history.clear()
        elif question == "/history":
            print("\n".join(f"{q}\n{a}" for q, a in history))
        elif question:
            answer = _asked(book, question, args, history)
            history.append((question, answer))
            print(answer, flush=True)


def _evaluation(spark, args) -> int:
    """0 if the targets are met, 1 if not, 2 if there can be no evaluation."""
    try:
        search.check_arguments(args.threshold)
        questions, models = files.load_questions(spark, args.questions), asking.loaded(args.models)
        problems = asking.evaluation.dataset_problems(questions).collect()
        if problems:
            raise ValueError("; ".join(f"{p['id']}: {p['problem']}" for p in problems))
        if args.generate and models.answer is None:
            raise ValueError("no answering model: nothing is indexed")
        book = asking.Book(files.read_chunks(spark, args.chunks), args.index or shared_path(spark, "index"), models)
        cases, total, met = book.evaluated(questions, args.threshold, args.generate)
        if args.output:
            files.write_report(cases.drop("groups"), f"{args.output}/cases")
            files.write_report(total, f"{args.output}/total")
        for row in total.where("category is null").toLocalIterator():
            print(json.dumps(row.asDict(recursive=True)))
        return int(not met)
    except Exception as e:  # whatever it is, there is no figure
        print(f"no evaluation: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


def _chunks(spark, args):
    book = books.read_books(spark, args.book)
    problems = ingest.preconditions(book.outline, book.page_counts, errors=book.errors).collect()
    if problems:
        print("\n".join(f"{p['book_id']}: {p['problem']}" for p in problems), file=sys.stderr)
        return None
    # The probe's report lies beside the chunks.
    files.write_report(_report(spark, args, book), f"{args.output}/probe")
    return ingest.ingest(book.lines, book.outline, book.page_counts, book.digests, args.max_tokens)


def _with_profiles(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--profiles-dir")
    parser.add_argument("--profile")
    parser.add_argument("--route", choices="ABC")


def run(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioscan")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("probe")
    p.add_argument("book")
    p.add_argument("--json")
    p.add_argument("--quiet", action="store_true")
    _with_profiles(p)
    p = sub.add_parser("ingest")
    p.add_argument("book")
    _with_profiles(p)
    p.add_argument("--output", required=True)
    p.add_argument("--max-tokens", type=int, default=1200)
    for name in ("ask", "repl", "evaluate"):
        p = sub.add_parser(name)
        p.add_argument("chunks")
        if name != "repl":
            p.add_argument({"ask": "question", "evaluate": "questions"}[name])
        p.add_argument("--threshold", type=float, default=search.THRESHOLD)
        p.add_argument("--models", help="module:name of the models in use")
        p.add_argument("--index", help="folder of the index, which is used again if it fits")
        if name == "evaluate":
            p.add_argument("--output")
            p.add_argument("--generate", action="store_true")
        else:
            p.add_argument("--top-k", type=int, default=search.TOP)
            p.add_argument("--debug", action="store_true")
    p = sub.add_parser("calibrate")
    p.add_argument("corpus")
    p.add_argument("--models")
    p.add_argument("--output")
    p = sub.add_parser("profile")
    p.add_argument("book")
    p.add_argument("--name", default="book")
    p = sub.add_parser("guard")
    p.add_argument("repository")
    p.add_argument("--staged", action="store_true")
    sub.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    spark = session()
    if args.command == "guard":
        listed = hygiene.paths(spark, args.repository, args.staged)
        sources = spark.createDataFrame([(open(f"{args.repository}/fixtures/SOURCES.md").read(),)], "text string") if listed.where("path = 'fixtures/SOURCES.md'").count() else spark.createDataFrame([], "text string")
        bad = hygiene.checked(listed, hygiene.declared(sources)).where("problem is not null").collect()
        print("\n".join(f"{r['path']}: {r['problem']}" for r in bad))
        return int(bool(bad))
    if args.command == "probe":
        book = books.read_books(spark, args.book)
        report = _report(spark, args, book)
        if args.json:
            files.write_report(report, args.json)
        if not args.quiet:
            for row in report.toLocalIterator():
                # One more than is shown is enough to see that there are more.
                bad = [] if book.errors is None else book.errors.where(F.col("book_id") == row["book_id"]).orderBy("pdf_index").limit(21).collect()
                print(probe.shown(row.asDict(recursive=True), [f"page {e['pdf_index'] + 1}: {e['problem']}" for e in bad]))
        return 0
    if args.command == "ingest":
        chunks = _chunks(spark, args)
        if chunks is None:
            return 1
        files.write_chunks(chunks, f"{args.output}/chunks")
        files.write_report(ingest.chunk_stats(files.read_chunks(spark, f"{args.output}/chunks")), f"{args.output}/stats")
        return 0
    if args.command == "profile":
        book = books.read_books(spark, args.book)
        row = textlayer.fingerprints(ingest.page_texts(book.lines)).join(book.page_counts, "book_id").first()
        print(profiles.template(row.asDict(), args.name), end="")
        return 0
    if args.command == "evaluate":
        return _evaluation(spark, args)
    try:
        if args.command == "calibrate":
            passages, cases, digest = files.load_calibration(spark, args.corpus)
            best = asking.calibrated(passages, cases, asking.loaded(args.models).rerank).withColumn("corpus_sha256", F.lit(digest))
            if args.output:
                files.write_report(best, args.output)
            print(json.dumps(best.first().asDict()))
            return 0
        if args.command == "ask" and not args.question.strip():
            raise ValueError("blank question")
        search.check_arguments(args.threshold, args.top_k)
        book = asking.Book(files.read_chunks(spark, args.chunks), args.index or shared_path(spark, "index"), asking.loaded(args.models))
        if args.command == "repl":
            _conversation(book, args)
        else:
            print(_asked(book, args.question, args), end="")
        return 0
    except ImportError as e:
        print(e, file=sys.stderr)
        return 2
    except (ValueError, OSError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run())
