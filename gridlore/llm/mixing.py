"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow. Its documents, shuffled by a hash, are served one after the other,
up to `max_repeats` rounds. A copy's virtual finish time is the cumulative words of its
source, this copy included, divided by the source's target. Serving the copies of all
sources in the order of virtual finish time, cut where the words of the total budget are
used up, gives each source its target to within about a document.

Nothing is gathered by source: cumulative words come from two levels of prefix sums
(source and hash bucket, then rows of a bucket), so a source with a third of all rows is
spread over all buckets. The cut is found in a histogram of virtual time with a fixed
number of bins and, exactly, in the one bin that the budget ends in.

Defined cases: a null or blank text has size 0 and is never copied; a very long text is taken
whole or not at all; null sources form one source that sorts last; a null key is a key like any
other; rows that repeat are separate documents, and ties of virtual time go by source, hash and
key; an empty table gives an empty mix; other columns ride along untouched, also if named like a working column (working
columns start with `__mix_`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import stage, with_word_count

#: Hash buckets of each source, and bins of virtual time from 0 to 2. Both are fixed; they bound what reaches the driver.
BUCKETS, BINS = 4096, 65536


def targets(sizes: DataFrame, weights=(1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, target) by water filling.

    Sources take the weights in turn, by code point, null last, and share the sum of all sizes.
    No target is above max_repeats times its source's size; what is over goes to the others by
    weight. Sorted by size/weight, the capped sources come first: a source is capped if its cap
    is below the share it would get of what the ones before it left.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    one = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source
    by_ratio = Window.orderBy("ratio", "rank")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    t = (
        sizes.withColumn("rank", F.row_number().over(one))
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))))
        .withColumn("free", F.col("ratio") > F.col("level"))
        .withColumn("free_level", F.max(F.when(F.col("free"), F.struct(-F.col("ratio"), -F.col("rank"), F.col("level")))).over(everything)["level"])
        .withColumn("target", F.when(F.col("free"), F.col("weight") * F.col("free_level")).otherwise(F.col("cap")).cast("double"))
    )
    return t.select("source", "source_size", "rank", "target")


def plan(docs: DataFrame, source: str = "source", key: str = "doc_id", weights=(1, 2, 3), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """docs, which have `__mix_size` (words), with `__mix_source_size`, `__mix_target`, `__mix_copies` (how often the mix
    takes the document) and `__mix_times` (the virtual finish times of those copies)."""
    # 60 bits of an MD5, which SQL engines have alike.
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("__mix_size").cast("string"))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    d = docs.withColumn("__mix_hash", h).withColumn("__mix_bucket", F.pmod(h, F.lit(BUCKETS)).cast("int"))
    d = d.withColumn("__mix_from", F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name")))
    by_bucket = stage(d.groupBy("__mix_from", "__mix_bucket").agg(F.sum("__mix_size").alias("words")), "mix-buckets")
    sizes = by_bucket.groupBy("__mix_from").agg(F.sum("words").alias("source_size"))
    goal = stage(
        targets(sizes.select(F.when(~F.col("__mix_from.none"), F.col("__mix_from.name")).alias("source"), "source_size"), weights, max_repeats).select(
            F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("__mix_from"),
            F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"), F.col("rank").alias("__mix_rank"),
        ), "mix-targets",
    )
    before = Window.partitionBy("__mix_from").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = by_bucket.join(goal, "__mix_from").select("*", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("__mix_start")).drop("words")
    inside = Window.partitionBy("__mix_from", "__mix_bucket").orderBy("__mix_hash", F.col(key).asc_nulls_first(), "__mix_size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(start, ["__mix_from", "__mix_bucket"]).withColumn("__mix_end", F.col("__mix_start") + F.sum("__mix_size").over(inside))
    d = d.withColumn(
        "__mix_times",
        F.when(
            (F.col("__mix_size") > 0) & (F.col("__mix_target") > 0),
            F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: (e * F.col("__mix_source_size") + F.col("__mix_end")) / F.col("__mix_target")),
        ).otherwise(F.array().cast("array<double>")),
    )
    copies = d.select("__mix_times", "__mix_size", "__mix_rank", "__mix_hash", F.col(key).cast("string").alias("id"))
    budget = goal.agg(F.sum("__mix_source_size")).first()[0] or 0
    last = _cut(stage(copies, "mix-times"), budget)
    taken = lambda v: F.struct(v, F.col("__mix_rank"), F.col("__mix_hash"), F.coalesce(F.col(key).cast("string"), F.lit(""))) <= last
    d = d.withColumn("__mix_times", F.filter("__mix_times", taken) if last is not None else F.array().cast("array<double>"))
    return d.withColumn("__mix_copies", F.size("__mix_times")).drop("__mix_from", "__mix_bucket", "__mix_hash", "__mix_start", "__mix_end", "__mix_rank")


def _cut(copies: DataFrame, budget: int):
    """The last copy, in the order (virtual finish time, source, hash, id), up to which all copies together have at most
    `budget` words; a struct column, or None if there is none. Equal-width ranges of virtual time hold about equal words."""
    width = 2.0 / BINS
    c = copies.select(F.explode("__mix_times").alias("v"), "__mix_size", "__mix_rank", "__mix_hash", F.coalesce("id", F.lit("")).alias("id"))
    c = c.withColumn("bin", F.least(F.floor(F.col("v") / width), F.lit(BINS)).cast("int"))
    words, at, bins = 0, None, c.groupBy("bin").agg(F.sum("__mix_size").alias("n")).orderBy("bin").collect()
    if not bins:
        return None
    for b in bins:  # at most BINS + 1 rows
        at = b["bin"]
        if words + b["n"] > budget:
            break
        words += b["n"]
    else:
        return F.struct(F.lit(float("inf")), F.lit(0), F.lit(0).cast("long"), F.lit(""))
    order = Window.partitionBy("bin").orderBy("v", "__mix_rank", "__mix_hash", "id").rowsBetween(Window.unboundedPreceding, 0)
    fits = c.filter(F.col("bin") == at).withColumn("run", F.sum("__mix_size").over(order)).filter(F.col("run") <= budget - words)
    m = fits.agg(F.max(F.struct("v", "__mix_rank", "__mix_hash", "id")).alias("m")).first()["m"]
    m = m or (at * width, -1, 0, "")  # nothing of this bin
    return F.struct(F.lit(float(m[0])), F.lit(m[1]), F.lit(m[2]).cast("long"), F.lit(m[3]))


def mix(docs: DataFrame, text: str = "text", partitions: int | None = None, **how) -> DataFrame:
    """The mix: docs' columns and `mix_time` (`__mix_time` if docs have a column of that name), a row for each copy taken, globally
    range-sorted by virtual finish time.

    Ranges are equal widths of virtual time, which hold about equal words, so no sampling pass is needed."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = docs.columns
    inner = [f"__mix_in_{k}" if c.startswith("__mix_") else c for k, c in enumerate(names)]  # no name is a working column's
    p = plan(with_word_count(docs.toDF(*inner), text, inner, "__mix_size"), **how)
    time = "__mix_time" if "mix_time" in names else "mix_time"
    rows = p.select(*(F.col(f"`{c}`").alias(name) for c, name in zip(inner, names)), F.explode("__mix_times").alias(time))
    part = F.least(F.floor(F.col(time) * n), F.lit(n - 1)).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions(time)


def mixed_documents(docs: DataFrame, text="text", source="source", key="doc_id", **how) -> DataFrame:
    """Per document: key, size, source_size, target, taken (words, repeats counted), copies."""
    d = stage(with_word_count(docs, text, (key, source), "__mix_size"), "mix-sizes")
    p = plan(d, source=source, key=key, **how)
    return p.select(
        F.col(key), F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"),
        (F.col("__mix_size") * F.col("__mix_copies")).cast("long").alias("taken"), F.col("__mix_copies").alias("copies"),
    )
