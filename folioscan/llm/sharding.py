"""Sharding by a hierarchical weighted hash tree, in DataFrame operations.

Regions hold racks and racks hold shards. At every level a document draws a number for each child, an
exponential variate -ln(u) / weight whose u is a hash of its id and the child's name, and goes to the child
with the smallest. A child's share follows its weight, a change of weights moves documents only into or out
of the subtrees whose weights change, and a new region takes documents only into itself.

Defined cases: a null text has size 1 and the checksum of the empty text; rows with one ``doc_id`` go to one
shard; a null ``doc_id`` is a key like any other; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: {region: {rack: {shard: weight}}}
Tree = dict[int, dict[int, dict[int, float]]]


def topology(shards: int, base: int = 8) -> Tree:
    """Up to ``base`` shards in two regions of two racks each; every shard beyond is a region of its own, so
    that growing by one shard leaves all other weights as they are."""
    tree: Tree = {}
    base = min(base, shards)
    for s in range(base):
        region, rest = (0, s) if s < (base + 1) // 2 else (1, s - (base + 1) // 2)
        own = (base + 1) // 2 if region == 0 else base // 2
        rack = 0 if rest < (own + 1) // 2 else 1
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    for s in range(base, shards):
        tree[2 + s - base] = {0: {s: 1.0}}
    return tree


def draw(key: Column, names: list[str], weights: list[float]) -> Column:
    """The index of the child that the key draws."""

    def variate(name: str, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
        return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))

    if len(names) == 1:
        return F.lit(0)
    drawn = F.array(*[F.struct(variate(n, w).alias("at"), F.lit(i).alias("i")) for i, (n, w) in enumerate(zip(names, weights, strict=True)) if w > 0])
    return F.array_min(drawn)["i"]


def weight_of(node) -> float:
    return sum(map(weight_of, node.values())) if isinstance(node, dict) else float(node)


def shard_of(key: Column, tree: dict, name: str = "") -> Column:
    """The shard to which the key descends."""
    children = sorted(tree)
    chosen = draw(key, [f"{name}/{c}" for c in children], [weight_of(tree[c]) for c in children])
    out = None
    for i, c in enumerate(children):
        below = shard_of(key, tree[c], f"{name}/{c}") if isinstance(tree[c], dict) else F.lit(c)
        out = F.when(chosen == i, below) if out is None else out.when(chosen == i, below)
    return out.cast("int")


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots are counted in two steps, within ``buckets`` hashed buckets of each shard (at least 256, or as many as
    shuffle partitions) and over the buckets' totals, so that no task numbers a whole shard. A bucket depends on the
    text too, so that rows that share an id are spread.
    """
    buckets = buckets or max(256, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce("text", F.lit(""))
    key = F.col("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(key, tree), "grown_shard": shard_of(key, grown) if grown else F.lit(None).cast("int"), "bucket": F.pmod(F.xxhash64(key, F.col("size"), F.col("text_crc32"), F.lit("slot")), F.lit(buckets)).cast("int")})
    totals = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # shards x buckets rows, whatever the documents
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(order) - 1)
    out = numbered.join(totals, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, tree: Tree, path: str) -> None:
    """The documents as Parquet, a folder for each shard."""
    placed = docs.select(F.struct("*").alias("doc"), shard_of(F.col("doc_id").cast("long"), tree).alias("shard"))
    placed.repartition("shard", F.pmod(F.xxhash64("doc.doc_id"), F.lit(16))).write.partitionBy("shard").parquet(path)
