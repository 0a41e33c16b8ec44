"""Hybrid search over many questions at once: two rankings, fusion, reranking, admission and distinct pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T

DEPTH, FUSION, TOP, THRESHOLD = 30, 60, 6, 0.1
#: Rows of questions that may be broadcast; beyond, they are joined by shuffles.
BROADCAST_ROWS = 10_000
#: Scores that a task holds at a time, and the decimal places by which they are ranked.
MOST_SCORES, PLACES = 1 << 21, 5


def check_arguments(threshold: float = THRESHOLD, top_k: int = TOP) -> None:
    if not 0 <= threshold <= 1 or top_k < 1:
        raise ValueError("threshold must be in [0, 1] and top_k at least 1")


def checked_questions(questions: DataFrame) -> DataFrame:
    """Questions; a blank one is an error."""
    return questions.where(F.when(F.trim(F.coalesce("question", F.lit(""))) == "", F.raise_error(F.lit("blank question"))).otherwise(F.lit(True)))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table as a broadcast side, if a count shows it to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top(scored: DataFrame, score: str, key: str, depth: int = DEPTH) -> DataFrame:
    """Of each question the ``depth`` best, ranked from 1; ties by the key. Each task keeps its own best first."""
    along = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= depth)


def question_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term): the distinct terms of each question; a broadcast side if they are few."""
    return small(questions.select("query_id", F.explode(F.array_distinct(T.terms(F.col("question")))).alias("term")), 20 * BROADCAST_ROWS)


def bm25(questions: DataFrame, impacts: DataFrame, key: str = "chunk_id", depth: int = DEPTH) -> DataFrame:
    """(query_id, key, score, rank): distinct terms of a question joined with impacts; only positive scores come out."""
    sums = impacts.join(question_terms(questions), "term").groupBy("query_id", key).agg(F.round(F.sum("impact"), 6).alias("score"))
    return top(sums.where("score > 0"), "score", key, depth)


def _matrices(queries: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """By dimension, ids and unit vectors of the questions whose vectors are whole and not zero."""
    ids, matrices = column(queries, "query_id"), {}
    for size, rows, vectors in _units(column(queries, "vector")):
        matrices[size] = (ids.take(pa.array(rows)), vectors)
    return matrices


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    found = table.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _units(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each dimension (dimension, rows, vectors of length 1); null and zero vectors, and those with a null in them, are left out."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        norm = np.sqrt((flat * flat).sum(1))
        good = norm > 0  # false for a null, which is NaN here
        yield size, rows[good], flat[good] / norm[good, None]


def _nearest(matrices: dict[int, tuple[pa.Array, np.ndarray]], key: str, depth: int):
    """Of each batch of vectors the ``depth`` best for each question, and all that round to the same score as the last of them."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, key)
            for size, rows, units in _units(column(batch, "vector")):
                ids, questions = matrices.get(size, (None, np.zeros((0, size))))
                step = max(1, MOST_SCORES // max(1, len(units)))
                for k in range(0, len(questions), step):
                    scores = questions[k : k + step] @ units.T
                    least = np.full(len(scores), -np.inf) if len(units) <= depth else np.partition(scores, len(units) - depth, axis=1)[:, len(units) - depth]
                    which, found = np.nonzero(scores >= least[:, None] - 2 * 10.0**-PLACES)
                    yield pa.record_batch([ids.take(pa.array(k + which)), keys.take(pa.array(rows[found])), pa.array(scores[which, found])], ["query_id", key, "score"])

    return nearest


def dense(queries: DataFrame, vectors: DataFrame, key: str = "chunk_id", depth: int = DEPTH) -> DataFrame:
    """(query_id, key, score, rank) by cosine, rounded; ties by key. Every vector meets every question: exact search of a
    stated set of questions, as products of matrices. The questions go to the tasks in blocks of at most
    ``BROADCAST_ROWS``, a batch of vectors keeps its own best for each question, and only these are shuffled.

    A vector that is null, zero or holds a null, or has another dimension than a question's, is no match for it.
    """
    blocks = max(1, -(-queries.count() // BROADCAST_ROWS))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    found = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        matrices = _matrices(own.select("query_id", "vector").toArrow())
        met = vectors.select(key, "vector").mapInArrow(_nearest(matrices, key, depth), schema)
        ranked = top(met.withColumn("score", F.round("score", PLACES)), "score", key, depth)
        found = ranked if found is None else found.unionByName(ranked)
    return found


def fuse(rankings: DataFrame, key: str = "chunk_id", k: int = FUSION) -> DataFrame:
    """(query_id, key, rrf, branch ranks): reciprocal rank fusion of (query_id, branch, key, rank); repeats count once, at their first."""
    first = rankings.groupBy("query_id", "branch", key).agg(F.min("rank").alias("rank"))
    again = F.row_number().over(Window.partitionBy("query_id", "branch").orderBy("rank"))
    first = first.withColumn("rank", again)
    side = lambda b: F.max(F.when(F.col("branch") == b, F.col("rank"))).alias(f"{b}_rank")
    return first.groupBy("query_id", key).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"), side("bm25"), side("dense"))


def both(bm25_: DataFrame, dense_: DataFrame, key: str = "chunk_id") -> DataFrame:
    pick = lambda d, b: d.select("query_id", F.lit(b).alias("branch"), key, "rank")
    return fuse(pick(bm25_, "bm25").unionByName(pick(dense_, "dense")), key)


def candidates(fused: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row for each page of each fused chunk, with its position among the question's candidates."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("dense_rank"), F.asc(key))
    placed = fused.withColumn("place", F.row_number().over(order))
    rows = placed.join(chunks.select(F.col("id").alias(key), "book_id", "section_path", F.posexplode("pages").alias("page_no", "page")), key)
    return rows.select("query_id", key, "book_id", "section_path", "rrf", "bm25_rank", "dense_rank", "place", "page_no", F.col("page.pdf_page").alias("pdf_page"), F.col("page.book_page").alias("book_page"), F.concat("section_path", F.lit("\n\n"), F.col("page.text")).alias("passage"), F.col("page.text").alias("text"))


def overlap_score(question, passage):
    """A deterministic stand-in for a reranking model: the share of the question's distinct terms in the passage."""
    own = F.array_distinct(T.terms(question))
    return F.size(F.array_intersect(own, T.terms(passage))) / F.greatest(F.size(own), F.lit(1))


def sigmoid(logit):
    """Scores of models that return logits, as probabilities."""
    return 1 / (1 + F.exp(-logit))


def checked_scores(scored: DataFrame) -> DataFrame:
    """Scores that are missing, not finite or outside [0, 1] are an error."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)
    return scored.where(F.when(bad, F.raise_error(F.lit("a rerank score is outside [0, 1]"))).otherwise(F.lit(True)))


def admitted(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All candidates of the questions whose best score reaches the threshold; weak ones of such a question stay."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("best", best).where(F.col("best") >= threshold).drop("best")


def distinct_pages(scored: DataFrame, top_k: int = TOP) -> DataFrame:
    """Of each page of a book its best hit, then the ``top_k`` best: by score, fusion, and candidate order."""
    order = [F.desc("score"), F.desc("rrf"), F.asc("place"), F.asc("page_no")]
    page = Window.partitionBy("query_id", "book_id", "pdf_page").orderBy(*order)
    first = scored.withColumn("r", F.row_number().over(page)).where("r = 1").drop("r")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top_k)


def search(questions: DataFrame, chunks: DataFrame, impacts: DataFrame, queries: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD, top_k: int = TOP, rerank=overlap_score, book_id: str | None = None) -> DataFrame:
    """Hits of each question: (query_id, question), with question vectors (query_id, vector) and chunk vectors.

    The reranker sees only the candidates of both branches. ``book_id`` restricts the search to one book.
    """
    check_arguments(threshold, top_k)
    questions = checked_questions(questions)
    if book_id is not None:
        chunks = chunks.where(F.col("book_id") == book_id)
        keys = chunks.select(F.col("id").alias("chunk_id"))
        impacts, vectors = impacts.join(keys, "chunk_id", "left_semi"), vectors.join(keys, "chunk_id", "left_semi")
    asked = small(questions.select("query_id", "question"))
    # Twice DEPTH rows a question at most: if the questions are few, so are these, and no chunk is shuffled for them.
    fused = both(bm25(questions, impacts), dense(queries, vectors))
    few = questions.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = candidates(F.broadcast(fused) if few else fused, chunks)
    scored = found.join(asked, "query_id").withColumn("score", rerank(F.col("question"), F.col("passage")))
    return distinct_pages(admitted(checked_scores(scored), threshold), top_k).drop("place", "page_no")
