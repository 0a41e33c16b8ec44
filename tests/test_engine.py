import io
import json
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from folioscan.operators import grounding as G
from folioscan.operators import textlayer
from folioscan.plans import cli, registry, tables
from folioscan.streaming import index_stream

HERE = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_nothing_outside_imports_the_subpackage():
    for path in [*HERE.glob("folioscan/**/*.py"), HERE / "bench.py"]:
        if "llm" not in path.parts:
            text = path.read_text()
            assert "import folioscan.llm" not in text and "from folioscan.llm" not in text, path


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns[:2] == ["query_id", "chunk_id"] and rows.count() > 0


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["normalize_lines", "run_merge", "section_paths", "asof_sections", "greedy_packing", "bm25_topk", "eval_rollup", "calibration_best"])
def test_queries_against_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in Path(SMALL).glob("*.parquet"):
        c.execute(f"create view {t.stem} as select * from '{t}'")
    own = registry.QUERIES[name](spark, SMALL)
    want = c.sql(registry.ORACLE_SQL[name])
    names = sorted(own.columns)
    assert names == sorted(want.columns)
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    order = [want.columns.index(n) for n in names]
    assert sorted([shown(r[n]) for n in names] for r in own.collect()) == sorted([shown(r[i]) for i in order] for r in want.fetchall())


def test_contents_of_all_customers(spark, tmp_path):
    """Every customer of a nation with enough for a table of contents is located in one of its books."""
    customers = [(k, nation) for k, nation in enumerate([0] * 100 + [1] * 41 + [2] * 8 + [3] * 3, 1)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    got = registry.QUERIES["toc_page_map"](spark, str(tmp_path)).collect()
    located = {}
    for r in got:
        located.setdefault(r["book_id"].split("-")[0], []).append(r["matched"])
        pages = 21 + r["matched"]
        assert (r["pdf_start"], r["pdf_end"], r["page_offset"], r["confidence"]) == (21, pages - 1, 4, min(0.5, r["matched"] / pages))
    assert {k: sorted(v) for k, v in located.items()} == {"n0": [33, 33, 34], "n1": [20, 21], "n2": [8]}


def test_scores_are_rounded_as_their_sql_does(spark, tmp_path):
    """0.285 is less than its decimal, so that its half is not one; Spark's own rounding goes by the decimal."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, k // 40, 5000.0 * k, "1-URGENT") for k in range(1, 400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"create view orders as from '{tmp_path}/orders.parquet/*.parquet'")
    wanted = sorted(map(tuple, db.execute(registry.ORACLE_SQL["distinct_page_topk"]).fetchall()))
    assert sorted(map(tuple, registry.QUERIES["distinct_page_topk"](spark, str(tmp_path)).collect())) == wanted


def test_pages_of_a_large_book_are_numbered_by_several_tasks(spark, tmp_path):
    rows = [((k * 7919 % 1000 - 500) * 10**12, "t", "en", None if k % 10 == 0 else "s") for k in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = tables.pages(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for source in ("s", None):
        ids = sorted(r[0] for r in rows if r[3] == source)
        assert sorted((r["pdf_index"], r["doc_id"]) for r in got if r["book_id"] == source) == list(enumerate(ids))
    tasks = [r["task"] for r in got if r["book_id"] == "s"]
    assert max(map(tasks.count, set(tasks))) < 600


def test_streamed_postings(spark, tmp_path):
    from tests.test_retrieval import demo
    from folioscan.operators import ingest
    from folioscan.sources import files

    files.write_chunks(ingest.ingest(*demo(spark)), str(tmp_path / "in"))
    stream = index_stream.keep_postings(index_stream.chunk_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("term = 'mist'").count() == 1
    # The same chunks once more, and a new one.
    again = files.read_chunks(spark, str(tmp_path / "in"))
    again.unionByName(again.limit(1).withColumns({"id": F.lit("new"), "text": F.lit("more mist")})).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = index_stream.keep_postings(index_stream.chunk_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == 2
    assert spark.read.parquet(str(tmp_path / "out")).where("term = 'mist'").count() == 2


def test_streamed_windows(spark, tmp_path):
    rows = spark.range(40).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (F.col("id") % 2).alias("user_id"), F.concat(F.lit("Line "), F.col("id").cast("string")).alias("text"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for made, name in ((index_stream.line_counts(source), "counted"), (index_stream.sessions(source), "sessions")):
        q = made.writeStream.outputMode("complete" if name == "counted" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.table("counted").collect()
    assert sum(r["n"] for r in got) == 40 and {r["masked"] for r in got} == {"line #"}


def test_the_command_line(spark, tmp_path, capsys):
    from tests.test_retrieval import demo

    lines, outline, _, _ = demo(spark)
    lines.write.parquet(str(tmp_path / "book/lines"))
    outline.write.parquet(str(tmp_path / "book/outline"))
    assert cli.run(["version"]) == 0
    assert cli.run(["probe", str(tmp_path / "book"), "--json", str(tmp_path / "report")]) == 0
    assert "pages: printed (standalone)" in capsys.readouterr().out
    assert cli.run(["ingest", str(tmp_path / "book"), "--output", str(tmp_path / "out")]) == 0
    assert cli.run(["ask", str(tmp_path / "out/chunks"), "the bridge of mist", "--top-k", "1"]) == 0
    assert '"page": 42' in capsys.readouterr().out
    outline.withColumn("pdf_index", F.lit(99).cast("long")).write.parquet(str(tmp_path / "bad/outline"))
    lines.write.parquet(str(tmp_path / "bad/lines"))
    assert cli.run(["ingest", str(tmp_path / "bad"), "--output", str(tmp_path / "no")]) == 1


def test_books_as_json_lines_with_fonts_images_and_errors(spark, tmp_path, capsys):
    """Four pages with folios 41 to 44; the third could not be read in the second book, whose text has no font."""
    from tests.test_retrieval import demo
    from folioscan.sources import books

    lines, outline, _, _ = demo(spark)
    other = lambda df: df.unionByName(df.withColumn("book_id", F.lit("c")))
    kept = other(lines).where("not (book_id = 'c' and pdf_index = 2)")
    for name, df in (("lines", kept), ("outline", other(outline))):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(df.toJSON().collect()))
    rows = {
        "fonts": [{"book_id": "b", "pdf_index": 0, "font": "A", "embedded": True}, {"book_id": "b", "pdf_index": 1, "font": "A", "embedded": True}, {"book_id": "b", "pdf_index": 1, "font": "", "embedded": True}, {"book_id": "c", "pdf_index": 0, "font": "B", "embedded": False}],
        "images": [{"book_id": "b", "pdf_index": k, "w": 300, "h": 200, "bytes": 9000} for k in range(4)],
        "errors": [{"book_id": "c", "pdf_index": 2, "problem": "unreadable"}],
    }
    for name, own in rows.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, own)))
    got = books.read_books(spark, str(tmp_path))
    assert {tuple(r) for r in got.page_counts.collect()} == {("b", 4), ("c", 4)}
    assert {tuple(r) for r in textlayer.embedded_fonts(got.fonts).collect()} == {("b", 1), ("c", 0)}
    assert cli.run(["probe", str(tmp_path), "--json", str(tmp_path / "report")]) == 0
    out = capsys.readouterr().out
    assert "images: 4, large: 4, heavy: True" in out and "columns: 1" in out and "errors: 1" in out and "page 3: unreadable" in out and out.count("no embedded font") == 1
    # A book with unread pages is not ingested.
    assert cli.run(["ingest", str(tmp_path), "--output", str(tmp_path / "no")]) == 1 and "c: pages could not be read" in capsys.readouterr().err
    with pytest.raises(ValueError):
        books.read_books(spark, str(tmp_path / "nothing"))
    (tmp_path / "outline.jsonl").write_text('{"book_id": 3, "ord": "x"}')
    with pytest.raises(Exception):
        books.read_books(spark, str(tmp_path)).outline.collect()


def test_asking_evaluating_and_calibrating(spark, tmp_path, capsys, monkeypatch):
    from tests.test_retrieval import demo
    from folioscan.operators import ingest
    from folioscan.sources import files

    files.write_chunks(ingest.ingest(*demo(spark)), str(tmp_path / "chunks"))
    chunks, models = str(tmp_path / "chunks"), ["--models", "tests.fakes:MODELS", "--index", str(tmp_path / "index")]
    # Both branches, and a grounded answer with its page.
    assert cli.run(["ask", chunks, "the bridge of mist", "--debug", *models]) == 0
    out = capsys.readouterr().out
    first = json.loads(out.splitlines()[0])
    assert first["page"] == 42 and first["bm25_rank"] == 1 and first["dense_rank"] is not None and out.splitlines()[-1] == "It is said. (p. 42)"
    assert len(list((tmp_path / "index").iterdir())) == 1
    # Nothing is found: a refusal, and nothing is sent.
    assert cli.run(["ask", chunks, "zzqy", *models]) == 0 and capsys.readouterr().out == G.NOT_FOUND
    assert cli.run(["ask", chunks, "the bridge of mist is cut", *models]) == 1 and "cut off" in capsys.readouterr().err
    assert cli.run(["ask", chunks, "  ", *models]) == 1 and cli.run(["ask", chunks, "q", "--threshold", "2", *models]) == 1
    assert cli.run(["ask", chunks, "q", "--models", "tests.no_such_module:X"]) == 2
    capsys.readouterr()
    # A conversation over one index; the history can be shown and cleared.
    monkeypatch.setattr("sys.stdin", io.StringIO("the bridge of mist\n\n/history\n/clear\n/history\nthe bridge of mist\n/quit\nnot read\n"))
    assert cli.run(["repl", chunks, *models]) == 0
    assert capsys.readouterr().out.splitlines() == ["It is said. (p. 42)", "the bridge of mist", "It is said. (p. 42)", "", "It is said. (p. 42)"]
    assert len(list((tmp_path / "index").iterdir())) == 1
    # Exit codes of an evaluation: met, not met, impossible.
    asked = [{"id": "a", "category": "factual", "question": "the bridge of mist", "expected_pages": [42]}]
    for name, page, code in (("good", 42, 0), ("bad", 7, 1)):
        (tmp_path / name).write_text("x")
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps({"questions": [asked[0] | {"expected_pages": [page]}]}))
        assert cli.run(["evaluate", chunks, str(path), "--output", str(tmp_path / f"out-{name}"), *models]) == code
        assert json.loads(capsys.readouterr().out)["recall_at_6"] == (code == 0)
    assert cli.run(["evaluate", chunks, str(tmp_path / "good.json"), "--generate", *models]) == 0
    assert json.loads(capsys.readouterr().out)["citation_exact"] == 1.0
    for argv in ([str(tmp_path / "none.json"), *models], [str(tmp_path / "good.json"), "--generate", "--models", "tests.fakes:EMBEDDING"], [str(tmp_path / "good.json"), "--threshold", "3", *models]):
        assert cli.run(["evaluate", chunks, *argv]) == 2
    (tmp_path / "c.json").write_text(json.dumps({"passages": [{"page": 1, "section": "s", "text": "the red door"}, {"page": 2, "section": "s", "text": "a blue wall"}], "cases": [{"question": "red door", "pages": [1]}, {"question": "green roof"}]}))
    capsys.readouterr()
    assert cli.run(["calibrate", str(tmp_path / "c.json"), "--output", str(tmp_path / "calibration")]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["accuracy"] == 1.0 and got["threshold"] == 1.0 and got["admitted"] == got["refused"] == 1 and len(got["corpus_sha256"]) == 64


def test_guard_of_a_repository(spark, tmp_path, capsys):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init")
    (tmp_path / "a.py").write_text("1")
    (tmp_path / ".env").write_text("x")
    run("add", "-A")
    assert cli.run(["guard", str(tmp_path), "--staged"]) == 1
    assert ".env: secret" in capsys.readouterr().out


def test_the_entry_works_without_the_subpackage(tmp_path):
    """A copy of the repository without it still imports and lists the other queries."""
    import shutil

    for name in ("folioscan", "__spark_entry__.py"):
        source = HERE / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    start = time.time()
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.returncode == 0, done.stderr + str(time.time() - start)
