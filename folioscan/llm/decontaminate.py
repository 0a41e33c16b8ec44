"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

Of every ``window`` consecutive words the fingerprint is the smallest hash of its k-grams. A window of an
item and an equal window of a document have the same fingerprint, so joining the two sets of fingerprints
meets every shared window. Neighbouring windows mostly share theirs, so a document has one row for each run of
them. The windows of a run that is met are then compared by their words with those of the items. Items with fewer
words than a window are one window, looked up by the hash of all their words.

The benchmark's fingerprints and its windows are broadcast if they take at most ``broadcast_bytes``, which is
measured first. Else runs are shuffled by fingerprint, without texts; texts move once, to the runs that were met.

Defined cases: null text has no words; an item without words has no window; an item that occurs twice under
one ``item_id`` is one item; a null ``item_id`` is no item; rows with one ``doc_id`` and text share a result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what separates words once A to Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that a row of one long and one int takes in a broadcast table, at most.
PRINT_BYTES = 64


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(folded, GAP), lambda w: w != "")


def _grams(words: str, k: int) -> Column:
    """Hashes of the k-grams of the array column ``words``, by their starts."""
    terms = ", ".join(f"get({words}, i + {j})" for j in range(k))
    return F.expr(f"if(size({words}) < {k}, array(), transform(sequence(0, size({words}) - {k}), i -> xxhash64({terms})))").cast("array<long>")


def _winnowed(grams: str, span: int) -> Column:
    """The smallest of each ``span`` consecutive hashes, by the starts of their windows."""
    terms = ", ".join(f"get({grams}, i + {j})" for j in range(span))
    least = f"least({terms})" if span > 1 else terms
    return F.expr(f"if(size({grams}) < {span}, array(), transform(sequence(0, size({grams}) - {span}), i -> {least}))").cast("array<long>")


def _prints(items: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """(print, length): the fingerprints of the items' windows."""
    full = items.where(F.size("words") >= window).select(_grams("words", k).alias("grams")).select(F.explode(_winnowed("grams", window - k + 1)).alias("print"), F.lit(window).alias("length"))
    for n in short:
        full = full.unionByName(items.where(F.size("words") == n).select(F.explode(_grams("words", n)).alias("print"), F.lit(n).alias("length")))
    return full.distinct()


def _found(docs: DataFrame, benchmark: DataFrame, window: int, k: int, broadcast_bytes: int) -> DataFrame:
    """doc_id, text_sha, spans, items: of the documents that share a window with an item."""
    items = benchmark.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    length = F.least(F.size("words"), F.lit(window))
    # At most window - 1 lengths
    short = sorted(r[0] for r in items.select(length.alias("n")).where(F.col("n") < window).distinct().collect())
    windows = items.withColumn("length", length).select("item_id", F.explode(F.expr("transform(sequence(1, size(words) - length + 1), i -> array_join(slice(words, i, length), ' '))")).alias("window")).distinct()
    prints = _prints(items, window, k, short).withColumnsRenamed({"print": "known", "length": "known_length"})
    taken = windows.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length(F.col("item_id").cast("string")) + PRINT_BYTES), F.lit(0))).first()[0]
    small = taken <= broadcast_bytes and prints.count() * PRINT_BYTES <= broadcast_bytes
    if small:
        windows, prints = F.broadcast(windows), F.broadcast(prints)

    def worded(texts: DataFrame) -> DataFrame:
        return texts.withColumn("words", words_of(F.col("text"))).drop("text")

    # Where the fingerprint differs from that of the window before
    begins = F.expr("if(size(least) = 0, array(), filter(sequence(0, size(least) - 1), s -> s = 0 or get(least, s) <> get(least, s - 1)))").cast("array<int>")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_sha"), "text")
    least = worded(texts).withColumn("grams", _grams("words", k)).withColumn("least", _winnowed("grams", window - k + 1)).withColumn("begins", begins)
    run = F.expr(f"transform(begins, (s, i) -> named_struct('print', get(least, s), 'first', s, 'n', coalesce(get(begins, i + 1), size(least)) - s, 'length', {window}))")
    kind = "array<struct<print: bigint, first: int, n: int, length: int>>"
    # Of the short lengths every start is a run of its own.
    def single(n: int) -> Column:
        return F.transform(_grams("words", n), lambda p, i: F.struct(p.alias("print"), i.alias("first"), F.lit(1).alias("n"), F.lit(n).alias("length"))).cast(kind)

    cast = least.select("doc_id", "text_sha", *(["words"] if small else []), F.explode(F.concat(run.cast(kind), *map(single, short))).alias("run"))
    met = cast.join(prints, (F.col("run.print") == F.col("known")) & (F.col("run.length") == F.col("known_length"))).drop("known", "known_length")
    if not small:
        # Runs without texts have been shuffled; each text with a run that was met is brought to its runs, once.
        where = met.groupBy("doc_id", "text_sha").agg(F.collect_set("run").alias("runs")).withColumnsRenamed({"doc_id": "met_id", "text_sha": "met_sha"})
        once = texts.groupBy("doc_id", "text_sha").agg(F.first("text").alias("text"))
        met = worded(once.join(where, F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("text_sha") == F.col("met_sha")))).select("doc_id", "text_sha", "words", F.explode("runs").alias("run"))
    # Extension: of the windows that share the fingerprint all words must agree.
    near = met.select("doc_id", "text_sha", "words", F.col("run.length").alias("length"), F.explode(F.expr("sequence(run.first, run.first + run.n - 1)")).alias("first"))
    near = near.select("doc_id", "text_sha", "first", "length", F.expr("array_join(slice(words, first + 1, length), ' ')").alias("window"))
    return near.join(windows, "window").groupBy("doc_id", "text_sha").agg(F.collect_set(F.struct("first", "length")).alias("spans"), F.collect_set("item_id").alias("items"))


def _told(rows: DataFrame, found: DataFrame) -> DataFrame:
    """What was found, beside each of the rows (doc_id, text_sha, n_words); nothing where nothing was."""
    own = found.select(F.col("doc_id").alias("found_id"), F.col("text_sha").alias("found_sha"), "spans", "items")
    met = rows.join(own, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_sha") == F.col("found_sha")), "left").drop("found_id", "found_sha")
    return met.withColumns({x: F.coalesce(x, F.array().cast(found.schema[x].dataType)) for x in ("spans", "items")})


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_sha"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 8, k: int = 5, broadcast_bytes: int = 32 << 20, every_row: bool = False) -> DataFrame:
    """Per document: doc_id, text_sha (that tells rows of one id apart), n_words, spans (first, length of matching windows), items.

    Rows with one id and text are one document, or with ``every_row`` each its own.
    """
    rows = _rows(docs)
    if not every_row:
        rows = rows.groupBy("doc_id", "text_sha").agg(F.max("n_words").alias("n_words"))
    return _told(rows, _found(docs, benchmark, window, k, broadcast_bytes))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, k: int = 5, most_items: int = 1, every_row: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (more than ``most_items``), spans, items."""
    found = hits(docs, benchmark, window, k, every_row=every_row)
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["length"] - 1)))))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    n_items = F.size("items").cast("long")
    return found.select(
        "doc_id", "n_words", hit.cast("long").alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_items > most_items).alias("contaminated"), "spans", "items", "text_sha",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 8, k: int = 5, most_items: int = 0, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The documents that share windows with at most ``most_items`` items, with all their columns."""
    bad = _found(docs, benchmark, window, k, broadcast_bytes).where(F.size("items") > most_items).select(F.col("doc_id").alias("bad_id"), F.col("text_sha").alias("bad_sha"))
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("sha"), F.struct("*").alias("row"))
    return named.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("sha") == F.col("bad_sha")), "left_anti").select("row.*")
