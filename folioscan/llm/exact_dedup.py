"""Exact deduplication as a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt to ``2 ** rounds`` runs by their id. Each run is sorted by digest and holds, for each text, its
count and the identifier that stays. In every round the runs whose numbers differ in one group of bits are
merged, until one run is left; then the decision goes back down the same tree, so that no join or merge meets
more than a round's share of one text's copies, however many there are. A digest counts as the same text
only together with a second hash and the length, which are carried and compared at every level.

Defined cases: null text counts as empty; a null ``doc_id`` never stays if a row of its group has an id; of
rows that share text and the id that stays, all count as staying; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The runs that one merge takes, as a power of two.
STEP = 3


def text_key(text: Column) -> Column:
    """What a text is known by: its SHA-256, with a second hash and its length to verify."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("second"), F.octet_length(text).cast("long").alias("bytes"))


def exact_dedup(docs: DataFrame, keep: str = "max", rounds: int = 6) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. ``keep``: the smallest or largest id stays."""
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    # The tree retains the smallest rank; nulls rank last.
    ranked_by = F.col if keep == "min" else F.bitwise_not  # which turns the order of all 64-bit numbers round
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(1 << rounds)).cast("int"))
    ranked = F.min(F.struct(F.col("doc_id").isNull().alias("none"), ranked_by("doc_id").alias("rank")))
    level = rows.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"), ranked.alias("first"))
    levels, steps = [level], [min(STEP, rounds - k) for k in range(0, rounds, STEP)]
    for step in steps:
        level = level.groupBy("key", F.shiftright("run", step).alias("run")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        levels.append(level)
    down = levels.pop()
    while levels:
        below = levels.pop().select("key", "run", F.shiftright("run", steps.pop()).alias("over"))
        told = down.select("key", F.col("run").alias("over"), "n", "first")
        down = below.join(told, ["key", "over"]).select("key", "run", "n", "first")
    out = rows.join(down, ["key", "run"])
    keep_id = ranked_by("first.rank")
    return out.select("doc_id", keep_id.alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("key.digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The documents that stay, with all their columns; of rows that share text and id one stays."""
    known = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")).alias("id")
    named = docs.select(known, text_key(F.col("text"))["digest"].alias("digest"), F.struct("*").alias("row"))
    firsts = exact_dedup(docs, keep).where("kept").select(known, F.unhex("text_sha256").alias("digest")).distinct()
    held = named.join(firsts, ["id", "digest"], "left_semi")
    return held.groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*")
