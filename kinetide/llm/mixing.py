"""Mixing sources to target weights by nested hash thresholds, without a sort."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetide.llm.common import WORD, staged, unused

WEIGHTS = (5, 2, 1)  # of the sources in order, again and again
SHARE = (3, 2)  # the mix takes 3/2 of all words
BITS, LEVEL = 60, 12  # bits of a document's hash, bits that one histogram looks at


def lot(doc_id: Column) -> Column:
    """60 bits that decide when a document is taken: the same on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(source, source_size, target) of the sources of docs (source, size): shares by weight, none above twice its size.

    Sources fill up in the order of size/weight: one is full if what is left, shared among it and all later ones, would give
    it twice its size or more. All comparisons are of whole numbers. The only window is over one row a source.
    """
    num, den = share
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sizes = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place % len(weights) + 1).cast("long"))
    scale = 1
    for w in weights:
        scale *= w
    order = Window.orderBy((F.col("source_size") * (F.lit(scale) / F.col("w")).cast("long")), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    gone = lambda c, f=F.lit(True): F.coalesce(F.sum(F.when(f, c)).over(before), F.lit(0))
    rows = sizes.select(
        "*", gone(F.col("source_size")).alias("c"), gone(F.col("w")).alias("v"), F.sum("w").over(everything).alias("all_w"), F.sum("source_size").over(everything).alias("all_size")
    )
    # 2 c is what the full ones took; both sides times den
    full = (F.lit(num) * F.col("all_size") - F.lit(2 * den) * F.col("c")) * F.col("w") >= F.lit(2 * den) * F.col("source_size") * (F.col("all_w") - F.col("v"))
    rows = rows.withColumn("full", full)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(everything), F.lit(0))
    weight = F.col("all_w") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(everything), F.lit(0))
    part = (F.lit(num) * F.col("all_size") - F.lit(2 * den) * taken) * F.col("w") / (F.lit(float(den)) * weight)
    return rows.select("source", "source_size", F.when(F.col("full"), (2 * F.col("source_size")).cast("double")).otherwise(part).alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): documents with a hash below the threshold come as near to the source's budget as any threshold does.

    The document at the border is taken if that leaves less above the budget than is short without it.

    A histogram of words by source and the first bits finds the bucket where the budget ends; only documents of that bucket
    are looked at again, by the next bits, so each level reads a 4096th of the level before.
    """
    edge = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        inside = rows.alias("r").join(edge.alias("e"), F.expr("r.source <=> e.source")).where(F.shiftright(F.col("lot"), shift + LEVEL) == F.col("prefix"))
        inside = inside.select(F.col("r.source").alias("source"), "size", "lot", "left")
        if shift < BITS - LEVEL:  # the first level is all rows
            inside = staged(inside, "boundary")
        sums = inside.groupBy("source", "left", F.shiftright("lot", shift).alias("prefix")).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("prefix"))
        over = sums.withColumn("run", run).where("run > left")
        first = over.groupBy("source").agg(F.min(F.struct("prefix", "left", "run", "size")).alias("x"))
        below, above = F.col("x.left") - (F.col("x.run") - F.col("x.size")), F.col("x.run") - F.col("x.left")
        edge = staged(first.select("source", below.alias("left"), "x.prefix", (above < below).cast("long").alias("border")), "edge")
        rows = inside.select("source", "size", "lot")
    return edge.select("source", (F.col("prefix") + F.col("border")).alias("threshold"))


def _plan(docs: DataFrame, weights: tuple[int, ...], share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Sizes and lots of the rows of docs; how often each source's documents are taken: times, once more below the threshold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = staged(rows.withColumn("lot", lot(F.col("doc_id"))), "sizes")
    goal = targets(rows, weights, share).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = staged(goal.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")), "targets")
    goal = goal.alias("g").join(_thresholds(rows, goal).alias("t"), F.expr("g.source <=> t.source"), "left")
    return rows, staged(goal.select("g.source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "times", F.coalesce("threshold", F.lit(0)).alias("threshold")), "goals")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs (doc_id, source, text).

    size: words of the text, 0 for null. Every document is taken target/source_size times, rounded down, and once more if
    its hash is below its source's threshold. Sources are weighed in code point order, null last. The hash is of the doc_id,
    so repeated rows are taken alike; null ids share one hash. If all texts are empty, targets are 0. Other columns are not
    read; an empty table gives an empty one.
    """
    rows, goal = _plan(docs, weights, share)
    joined = rows.alias("r").join(goal.alias("g"), F.expr("r.source <=> g.source"))
    times = F.col("times") + (F.col("lot") < F.col("threshold")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of docs, as many copies of each as mix_sources takes; columns stay as they are."""
    _, goal = _plan(docs, weights, share)
    copy = unused("copy", docs)
    times = (F.col("g.times") + (lot(F.col("d.doc_id").cast("long")) < F.col("g.threshold")).cast("long")).cast("int")
    joined = docs.alias("d").join(goal.alias("g"), F.expr("d.source <=> g.source")).where(times > 0)
    return joined.select("d.*", F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).drop(copy)
