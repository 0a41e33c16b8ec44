"""Questions to one book: an index that is built once, hits, grounded answers, evaluation and calibration."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import evaluation, grounding, index, search
from folioscan.sources import models

#: Turns of a conversation that go with a question.
TURNS = 12
HISTORY = "array<struct<question:string,answer:string>>"


@dataclass(frozen=True)
class Models:
    """The models in use. ``name`` goes into the fingerprint of the index. ``embed`` and ``answer`` load a model in a task
    (texts to vectors, a prompt to a reply); without them there is no dense branch, or no answer but the hits."""

    name: str = "terms"
    embed: Callable[[], Callable] | None = None
    rerank: Callable = search.overlap_score
    answer: Callable[[], Callable] | None = None


def loaded(where: str | None) -> Models:
    """The Models that ``module:name`` names."""
    if not where:
        return Models()
    module, _, name = where.partition(":")
    found = getattr(importlib.import_module(module), name or "MODELS")
    if not isinstance(found, Models):
        raise ValueError(f"{where} is no Models")
    return found


class Book:
    """The index of a book's chunks under a folder, which any number of questions use."""

    def __init__(self, chunks: DataFrame, folder: str, models_: Models = Models()):
        problems = [r[0] for r in index.validate(chunks).collect()]
        if problems:
            raise ValueError("no index: " + ", ".join(problems))
        self.spark: SparkSession = chunks.sparkSession
        self.chunks, self.models = chunks, models_
        own = index.build(chunks, self._embedded(chunks, "id", "text", "chunk_id"), models_.name, folder)
        self.impacts, self.vectors = (self.spark.read.parquet(f"{own}/{x}") for x in ("impacts", "vectors"))

    def _embedded(self, rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
        """(name, vector) of each row; no rows without a model."""
        if self.models.embed is None:
            return rows.select(F.col(key).alias(name), F.array().cast("array<float>").alias("vector")).limit(0)
        return rows.select(F.col(key).alias(name), models.embedder(self.models.embed)(F.col(text)).alias("vector"))

    def hits(self, questions: DataFrame, threshold: float = search.THRESHOLD, top_k: int = search.TOP) -> DataFrame:
        """Hits of questions (query_id, question)."""
        queries = self._embedded(questions, "query_id", "question", "query_id")
        return search.search(questions, self.chunks, self.impacts, queries, self.vectors, threshold, top_k, self.models.rerank)

    def answers(self, questions: DataFrame, hits: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """(query_id, answer, error): what the hits establish. A question without hits is refused and not sent."""
        if self.models.answer is None:
            raise ValueError("the models have no answering one")
        order = F.array_sort(F.collect_list(F.struct("rank", "section_path", "text", "book_page")))
        told = hits.groupBy("query_id").agg(F.transform(order, lambda h: F.struct(h["section_path"].alias("section_path"), h["text"].alias("text"), h["book_page"].alias("book_page"))).alias("hits"))
        asked = questions.join(told.select("query_id"), "query_id", "left_semi")
        ready = grounding.prompts(asked, hits.select("query_id", "rank", "section_path", "text"), history)
        replies = models.answered(ready.where("problem is null").select("query_id", "prompt"), self.models.answer)
        good = grounding.validated(replies.where("raw is not null").select("query_id", "raw").join(told, "query_id")).select("query_id", "answer", "error")
        none = F.lit(None).cast("string")
        failed = replies.where("raw is null").select("query_id", none.alias("answer"), "error")
        large = ready.where("problem is not null").select("query_id", none.alias("answer"), F.col("problem").alias("error"))
        without = questions.join(told, "query_id", "left_anti").select("query_id", F.lit(grounding.NOT_FOUND).alias("answer"), none.alias("error"))
        return good.unionByName(failed).unionByName(large).unionByName(without)

    def evaluated(self, questions: DataFrame, threshold: float = search.THRESHOLD, generate: bool = False) -> tuple[DataFrame, DataFrame, bool]:
        """Cases, their roll-up, and whether the targets are met, for a question set."""
        asked = questions.select(F.col("id").alias("query_id"), "question")
        hits = self.hits(asked, threshold)
        cases = evaluation.retrieval_cases(questions, hits)
        total = evaluation.roll_up(cases)
        met = bool(total.where("category is null").first()["target_met"])
        if generate:
            answers = self.answers(asked, hits).withColumnRenamed("query_id", "id")
            cases = evaluation.answer_cases(cases.join(answers, "id"))
            sums = evaluation.answer_roll_up(cases)
            total = total.crossJoin(F.broadcast(sums))  # one row
            met = met and bool(total.first()["generation_target_met"])
        return cases, total, met


def calibrated(passages: DataFrame, cases: DataFrame, rerank: Callable = search.overlap_score) -> DataFrame:
    """One row: the threshold that tells cases with a passage from those without. Every case of the stated set meets every passage."""
    met = search.small(cases).crossJoin(search.small(passages))
    scored = met.withColumn("score", rerank(F.col("question"), F.concat("section", F.lit("\n\n"), F.col("text")))).select("query_id", "page", "score", "pages")
    return evaluation.calibrated(evaluation.accuracy_grid(evaluation.case_scores(search.checked_scores(scored))))
