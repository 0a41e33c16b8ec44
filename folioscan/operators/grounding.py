"""Checks that an answer says only what its evidence says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T

# The answers that refuse.
NOT_FOUND, NOT_ESTABLISHED = "Ce n'est pas dans le manuel.", "Ce n'est pas établi par le manuel."
NOT_FOUND_EN, NOT_ESTABLISHED_EN = "This is not in the manual.", "This is not established by the manual."
REFUSALS = (NOT_FOUND, NOT_ESTABLISHED, NOT_FOUND_EN, NOT_ESTABLISHED_EN)
NEAREST, NEAREST_EN = " Section proche : ", " Closest section: "

REPLY = "struct<kind:string,reply:string,claims:array<struct<source:bigint,text:string,quote:string>>>"
LEAST_QUOTE, MOST_PASSAGE, MOST_HITS, MOST_EVIDENCE = 20, 40_000, 6, 80_000


def parsed(raw: Column, schema: str, keys: list[str]) -> Column:
    """The JSON object, or null if it is not one or has other keys than ``keys``."""
    names = F.json_object_keys(raw)
    return F.when(F.size(F.array_except(names, F.array(*[F.lit(k) for k in keys]))) == 0, F.from_json(raw, schema))


def nearest(refusal: Column, section: Column) -> Column:
    """A refusal followed by the section of the best hit."""
    label = F.when(refusal.startswith("This "), F.lit(NEAREST_EN)).otherwise(F.lit(NEAREST))
    return F.concat(refusal, F.coalesce(F.concat(label, section, F.lit(".")), F.lit("")))


def has_reference(text: Column) -> Column:
    return F.rlike(text, F.lit(T.PAGE_REFERENCE))


def claim_holds(claim: Column, hits: Column) -> Column:
    """A claim's source exists and has a printed page, its quote stands there between word ends, its numbers are in
    the quote, and it names no page itself. ``hits``: array of struct(text, book_page)."""
    hit = F.get(hits, claim["source"].cast("int"))
    quote, text = T.squeeze(claim["quote"]), T.squeeze(claim["text"])
    quoted = T.contains_word(T.squeeze(hit["text"]), quote)
    return F.coalesce(
        (claim["source"] >= 0) & hit["book_page"].isNotNull() & (F.length(text) > 0) & (F.length(quote) >= LEAST_QUOTE) & quoted & ~has_reference(text)
        & (F.size(F.array_except(T.numbers(text), T.numbers(quote))) == 0),
        F.lit(False),
    )


def validated(replies: DataFrame) -> DataFrame:
    """Replies (raw JSON, hits: array of struct(section_path, text, book_page)) with ``answer``.

    Any claim that fails rejects the whole answer. Malformed JSON gives a null answer and ``error``.
    """
    rows = replies.withColumn("r", parsed(F.col("raw"), REPLY, ["kind", "reply", "claims"]))
    claims, said = F.coalesce(F.col("r.claims"), F.array().cast("array<struct<source:bigint,text:string,quote:string>>")), F.coalesce("r.reply", F.lit(""))
    no = F.lit(NOT_ESTABLISHED)
    refusal = F.when((F.size(claims) == 0) & ((said == "") | said.isin(*REFUSALS)), nearest(F.when(said == "", no).otherwise(said), F.get("hits", F.lit(0))["section_path"])).otherwise(no)
    clear = (F.size(claims) == 0) & F.contains(said, F.lit("?")) & ~has_reference(said) & ~F.rlike(said, F.lit(r"(?U)\d"))
    lines = F.transform(claims, lambda c: F.concat(T.squeeze(c["text"]), F.lit(" (p. "), F.get("hits", c["source"].cast("int"))["book_page"].cast("string"), F.lit(")")))
    good = (said == "") & (F.size(claims) > 0) & F.forall(claims, lambda c: claim_holds(c, F.col("hits")))
    answer = F.when(F.col("r.kind") == "refusal", refusal).when(F.col("r.kind") == "clarification", F.when(clear, said).otherwise(no)).when(F.col("r.kind") == "answer", F.when(good, F.array_join(lines, "\n")).otherwise(no))
    return rows.withColumn("answer", answer).withColumn("error", F.when(F.col("answer").isNull(), "invalid reply")).drop("r")


def passage_answer(text: Column, book_page: Column, established: Column, answer: Column) -> Column:
    """The answer if every sentence of it is a whole sentence of the passage and it names no other page.

    No passage at all, a page that was not measured, and everything not shown are refused.
    """
    pages = T.referenced_pages(answer)
    bare = F.trim(F.regexp_replace(answer, T.PAGE_REFERENCE, ""))
    own = T.sentences(bare)
    good = established & (F.trim(answer) != "") & ~F.exists(pages, lambda p: p != book_page) & (F.size(F.array_except(own, T.sentences(text))) == 0)
    return F.when(text.isNull(), NOT_FOUND).when(book_page.isNull(), NOT_ESTABLISHED).when(F.coalesce(good, F.lit(False)), F.concat(F.array_join(own, " "), F.lit(" (p. "), book_page.cast("string"), F.lit(")"))).otherwise(NOT_ESTABLISHED)


def guarded(evidence: DataFrame) -> DataFrame:
    """Per question (query_id, text): hits and characters of evidence; too many are an error, never cut."""
    sums = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.length("text")).alias("chars"))
    return sums.withColumn("problem", F.when(F.col("hits") > MOST_HITS, "too many hits").when(F.col("chars") > MOST_EVIDENCE, "too much evidence"))


def prompts(questions: DataFrame, evidence: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt, problem): JSON of question, the last turns and the evidence by rank; page numbers are left out.

    Evidence is never cut: with too many hits, or too much of it, there is a problem in the prompt's place.
    """
    bad = guarded(evidence).where("problem is not null").select("query_id", "problem")
    own = evidence.join(bad, "query_id", "left_anti").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section_path", "text"))), lambda x: F.struct((x["rank"] - 1).alias("source"), x["section_path"].alias("section"), x["text"].alias("text"))).alias("evidence"))
    rows = questions.join(bad, "query_id", "left").join(own, "query_id", "left")
    if history is not None:
        rows = rows.join(history, "query_id", "left")
    else:
        rows = rows.withColumn("history", F.array().cast("array<string>"))
    return rows.select("query_id", F.when(F.col("problem").isNull(), F.to_json(F.struct("question", "history", "evidence"))).alias("prompt"), "problem")


def last_turns(turns: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` turns of each conversation, numbered from the last."""
    along = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(along)).where(F.col("back") <= n)
