"""URL rules by a sort-merge range join, in DataFrame operations only.

A host is written in reverse, ``www.example.org`` as ``org,example,www,``; behind it stands the path. All
addresses under a rule then lie in one interval of this order, and intervals of rules nest. As a rule holds
for its host and every subdomain, a url stands once for each suffix of its host. Urls and the ends of the
intervals are sorted together and swept; the rules that are open at a point form a stack, of which the top
is the longest that fits. Urls are dealt to ``slices`` slices by page, so that a host with a third of the urls is
spread like any other, and each slice is swept beside the rules of the hosts that occur in it.

Defined cases: a null url, or one without ``://``, has empty host and path and gets the default verdict. Of
rules with one host and path the first given counts. The length of a rule is that of its text, in characters; of
equally long rules that fit, the first given counts. Urls that occur several times are judged each. A null rule or
verdict is no rule; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.llm.exchange import written

#: The rules of the contract (verdict, host/path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from behind the first ``://`` up to ``/ ? #``, A to Z lower-cased; path: on to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def order_key(labels: Column, path: Column) -> Column:
    """Bytes in whose order the names under a host and path are an interval. No label holds a byte 1."""
    return F.encode(F.concat(F.array_join(labels, "\x01"), F.lit("\x01\x01"), path), "utf-8")


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """n, verdict, rule, host, path, key: one row for each rule, the first of equal ones.

    ``rules`` is a sequence of (verdict, rule), or for long lists a DataFrame of n (the place in the list), verdict, rule.
    """
    if isinstance(rules, DataFrame):
        given = rules.select(F.col("n").cast("long").alias("n"), "verdict", "rule").where("verdict is not null and rule is not null")
    else:
        rows = [F.struct(F.lit(n).cast("long").alias("n"), F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for n, (v, r) in enumerate(rules)]
        given = spark.range(1).select(F.inline(F.array(*rows)))
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    split = given.select("n", "verdict", "rule", host.alias("host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"))
    first = split.groupBy("host", "path").agg(F.min(F.struct("n", "verdict", "rule")).alias("r")).select("r.*", "host", "path")
    return first.withColumn("key", order_key(reversed_labels(F.col("host")), F.col("path")))


def boundaries(rules: DataFrame) -> DataFrame:
    """host, key, stack: the ends of the rules' intervals, each with the stack of rules that are open from there on.

    Intervals of prefixes nest or are apart, so what is open at a rule's start is the rules whose keys are
    prefixes of its own; its end lies before the next key that does not begin with it. The stack is built
    from the shorter rules of a host, joined on the prefixes that occur as rules.
    """
    prefixes = rules.select("n", "host", F.col("key").alias("own"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("k"), "path")
    prefixes = prefixes.select("n", "host", "own", F.expr("substring(path, 1, k)").alias("path"))
    # The longest first, of equally long ones the first given.
    rule = F.struct(F.length("rule").alias("size"), (-F.col("n")).alias("early"), "rule", "verdict").alias("rule")
    open_ = prefixes.join(rules.select("host", "path", rule), ["host", "path"]).groupBy("n", "host", "own").agg(F.sort_array(F.collect_list("rule"), asc=False).alias("stack"))
    starts = open_.select("host", F.col("own").alias("key"), "stack")
    # Behind its interval a rule is off the stack: byte 0xFF is in no UTF-8 text, so key + FF closes it.
    ends = open_.select("host", F.concat("own", F.unhex(F.lit("FF"))).alias("key"), F.expr("slice(stack, 2, greatest(size(stack) - 1, 0))").alias("stack"))
    return starts.unionByName(ends).withColumn("kind", F.lit(0))


def url_verdicts(pages: DataFrame, rules=RULES, default: str = "allow", slices: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict."""
    spark = pages.sparkSession
    slices = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    # A page's copies for the suffixes of its host go to one slice, and there into one group. The slices are read
    # twice and are the same both times, as they are written first; equal rows may lie in different ones.
    urls = written(urls.withColumn("slice", F.pmod(F.xxhash64("page_id", "row"), F.lit(slices)).cast("int")), "urls")
    labels = reversed_labels(F.col("host"))
    points = urls.select("*", labels.alias("labels"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("depth"))
    points = points.withColumn("labels", F.expr("slice(labels, 1, depth)")).drop("depth")
    # A slice needs the rules of the hosts that it meets.
    met = points.select("slice", F.array_join(F.reverse("labels"), ".").alias("host")).distinct()
    marks = boundaries(rule_table(spark, rules)).join(met, "host").select("slice", "key", "kind", "stack")
    points = points.select("slice", "row", "page_id", "host", "path", order_key(F.col("labels"), F.col("path")).alias("key"), F.lit(1).alias("kind"))
    swept = points.unionByName(marks, allowMissingColumns=True)
    along = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = swept.withColumn("open", F.last("stack", ignorenulls=True).over(along)).where("kind = 1")
    top = F.get("open", F.lit(0))
    best = found.groupBy("slice", "row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(top).alias("top"))
    return best.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
