"""Ordered calculations over series of any length.

A plain window over (session) puts a whole session in one task. Here every series is cut into buckets that
follow its order; rows are windowed inside (key, bucket) and a small per-bucket summary carries the state over
the bucket borders. Results equal those of the unbucketed window.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RANK_STEPS = 16
BRACKET = 5e-4  # half width in rank of the slice around a wanted percentile; the sketch errs by at most 1e-4


def _position(order: Sequence[str]) -> Column:
    """Sort position for max_by/min_by; a single column keeps the aggregation hash based."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


@dataclass(frozen=True)
class Running:
    """A running value: kind is sum, max, min or last (last non-null so far); `reverse` runs from the end."""

    kind: str
    value: Column
    inclusive: bool = True
    reverse: bool = False


def time_bucket(t: Column | str, width: int) -> Column:
    column = F.col(t) if isinstance(t, str) else t
    return ((column - F.pmod(column, F.lit(width))) / F.lit(width)).cast("long")  # exact for any 53-bit integer


def _over_rows(kind: str, column: Column, window) -> Column:
    return {
        "sum": F.sum(column),
        "max": F.max(column),
        "min": F.min(column),
        "last": F.last(column, ignorenulls=True),
    }[kind].over(window)


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    specs: dict[str, Running],
    reverse_order: Sequence[str] | None = None,
) -> DataFrame:
    """Add running values per `keys` in `order`; reversed ones go backwards through `reverse_order`.

    `bucket` must not decrease along either order. The carry table has one row per (key, bucket). The input is read
    twice, once for the carry and once for the rows, whatever the number of values.
    """
    spot = [*keys, bucket]
    base = df.select("*", *[s.value.alias(f"__v_{n}") for n, s in specs.items()])
    forward, backward = list(order), list(reverse_order or order)

    def summary(name: str, spec: Running) -> Column:
        value = F.col(f"__v_{name}")
        if spec.kind == "last":
            position = F.when(value.isNotNull(), _position(backward if spec.reverse else forward))
            return (F.min_by if spec.reverse else F.max_by)(value, position).alias(f"__b_{name}")
        return {"sum": F.sum, "max": F.max, "min": F.min}[spec.kind](value).alias(f"__b_{name}")

    def across(spec: Running):
        return W.partitionBy(*keys).orderBy(F.col(bucket).desc() if spec.reverse else F.col(bucket).asc()).rowsBetween(
            W.unboundedPreceding, -1
        )

    carried = (
        base.groupBy(*spot)
        .agg(*[summary(n, s) for n, s in specs.items()])
        .select(*spot, *[_over_rows(s.kind, F.col(f"__b_{n}"), across(s)).alias(f"__c_{n}") for n, s in specs.items()])
    )

    def combined(name: str, spec: Running) -> Column:
        ordering = [F.col(c).desc() for c in backward] if spec.reverse else [F.col(c).asc() for c in forward]
        frame = W.partitionBy(*spot).orderBy(*ordering).rowsBetween(
            W.unboundedPreceding, W.currentRow if spec.inclusive else -1
        )
        inside, before = _over_rows(spec.kind, F.col(f"__v_{name}"), frame), F.col(f"__c_{name}")
        if spec.kind == "sum":
            return F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
        if spec.kind == "last":
            return F.coalesce(inside, before)
        return (F.greatest if spec.kind == "max" else F.least)(before, inside)

    joined = base.join(carried, spot, "left")
    return joined.select(*df.columns, *[combined(n, s).alias(n) for n, s in specs.items()])


def previous(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], columns: dict[str, Column],
    second: dict[str, Column] | None = None,
) -> DataFrame:
    """Add the preceding row's values (NULL for the first row of a series), and on request those of the row before it.

    The carry holds the last two rows of the buckets before, so both come from one pass.
    """
    spot = [*keys, bucket]
    second = second or {}
    values = {**columns, **{f"2{n}": c for n, c in second.items()}}
    pack = lambda prefix: F.struct(*[F.col(f"{prefix}{n}").alias(n) for n in values])
    base = df.select("*", *[c.alias(f"__v_{n}") for n, c in values.items()])
    here = W.partitionBy(*spot).orderBy(*order)
    across = W.partitionBy(*keys).orderBy(bucket)
    position = _position(order)
    rows = base
    if second:
        rows = base.select("*", *[F.lag(f"__v_{n}").over(here).alias(f"__w_{n}") for n in values],
                           F.lag(F.lit(1)).over(here).alias("__has"))
    last = lambda prefix: [F.max_by(f"{prefix}{n}", position).alias(f"{prefix}{n}") for n in values]
    ends = rows.groupBy(*spot).agg(*last("__v_"), *(last("__w_") + [F.max("__has").alias("__has")] if second else []))
    packed = ends.select(*spot, pack("__v_").alias("__end"), *([F.when(F.col("__has") == 1, pack("__w_")).alias("__end2")] if second else []))
    older = F.coalesce(F.lag("__end2").over(across), F.lag("__end", 2).over(across)) if second else F.lit(None)
    carried = packed.select(*spot, F.lag("__end").over(across).alias("__c1"), older.alias("__c2"))
    joined = base.join(carried, spot, "left")
    first = F.row_number().over(here)
    value = lambda n: F.when(F.col("__at") == 1, F.col(f"__c1.{n}")).otherwise(F.col(f"__l_{n}"))
    ranked = joined.select(
        "*", first.alias("__at"), *[F.lag(f"__v_{n}").over(here).alias(f"__l_{n}") for n in columns],
        *[F.lag(f"__v_2{n}", 2).over(here).alias(f"__m_{n}") for n in second],
    )
    older_value = lambda n: F.when(F.col("__at") == 1, F.col(f"__c2.2{n}")).when(F.col("__at") == 2, F.col(f"__c1.2{n}")).otherwise(F.col(f"__m_{n}"))
    return ranked.select(*df.columns, *[value(n).alias(n) for n in columns], *[older_value(n).alias(n) for n in second])


def islands(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], flag: Column, name: str = "island") -> DataFrame:
    """Number the stretches of equal `flag` (a boolean) along each series.

    Changes inside a bucket are counted there; the change at a bucket's border is known once the last flag of the
    bucket before it is, so one carry per bucket gives every row its number.
    """
    spot = [*keys, bucket]
    here = W.partitionBy(*spot).orderBy(*order)
    base = df.withColumn("__flag", flag)
    changed = base.withColumn("__change", F.coalesce(F.col("__flag") != F.lag("__flag").over(here), F.lit(False)).cast("long"))
    position = _position(order)
    ends = changed.groupBy(*spot).agg(
        F.min_by("__flag", position).alias("__first"), F.max_by("__flag", position).alias("__last"), F.sum("__change").alias("__inner")
    )
    across = W.partitionBy(*keys).orderBy(bucket)
    border = F.coalesce(F.col("__first") != F.lag("__last").over(across), F.lit(False)).cast("long")
    bordered = ends.withColumn("__border", border)
    before = F.coalesce(F.sum(F.col("__inner") + F.col("__border")).over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = bordered.select(*spot, (before + F.col("__border")).alias("__base"))
    return changed.join(carried, spot, "left").select(
        *df.columns, (F.col("__base") + F.sum("__change").over(here.rowsBetween(W.unboundedPreceding, W.currentRow))).alias(name)
    )


def row_numbers(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """1-based position of every row in its series."""
    return running(df, keys, bucket, order, {name: Running("sum", F.lit(1).cast("long"))})


def trailing_halo(df: DataFrame, t: str, width: int, lookback: int) -> DataFrame:
    """Copy rows into every later bucket whose rows can look back to them; `__core` marks the home bucket."""
    home = time_bucket(t, width)
    last = time_bucket(F.col(t) + F.lit(lookback), width)
    return df.select("*", home.alias("__home"), F.explode(F.sequence(home, last)).alias("__bucket")).withColumn(
        "__core", F.col("__home") == F.col("__bucket")
    ).drop("__home")


def _tagged(df: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Attach to df each key's sketch quantiles over `rows` as `__cuts` (a bounded number per key)."""
    sketch = F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs]), F.lit(10000)).alias("__cuts")
    if keys:
        return df.join(rows.groupBy(*keys).agg(sketch), list(keys), "left")
    one = F.lit(0).alias("__all")
    return df.withColumn("__all", one).join(F.broadcast(rows.agg(sketch).withColumn("__all", one)), "__all").drop("__all")


def rank_buckets(df: DataFrame, keys: Sequence[str], value: str, bucket: str = "__bucket") -> DataFrame:
    """Cut an arbitrary numeric column into about equally full buckets per key.

    Cut points come from a mergeable quantile sketch (RANK_STEPS^2 - 1 numbers per key), so bucket sizes are
    approximate while the order of buckets is exact. The search goes by coarse and then by fine cuts.
    """
    n = RANK_STEPS
    tagged = _tagged(df, df, keys, value, [i / (n * n) for i in range(1, n * n)])
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(value)))
    coarse = F.array(*[F.element_at("__cuts", n * i) for i in range(1, n)])
    return tagged.withColumn("__coarse", below(coarse)).withColumn(
        bucket, F.col("__coarse") * n + below(F.slice("__cuts", F.col("__coarse") * n + 1, F.lit(n - 1)))
    ).drop("__cuts", "__coarse")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per key without holding a group in one aggregation buffer.

    Two sketch cut points bracket each wanted rank; exact counts tell which slice holds it, and only that slice (about
    a thousandth of a large group) is sorted.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    edges = sorted({min(1.0, max(0.0, p + side)) for p in probs.values() for side in (-BRACKET, BRACKET)})
    placed = _tagged(counted, df, keys, value, edges).withColumn(
        "__bucket", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    per_bucket = placed.groupBy(*keys, "__bucket").agg(F.sum("__n").alias("__n"))
    wk = W.partitionBy(*keys)
    prefix = F.coalesce(F.sum("__n").over(wk.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = per_bucket.select(*keys, "__bucket", prefix.alias("__from"), F.col("__n").alias("__size"),
                              F.sum("__n").over(wk).alias("__total"))
    wanted = F.array(*[
        F.struct(F.lit(n).alias("name"), ((F.col("__total") - 1) * F.lit(float(p))).alias("pos"))
        for n, p in probs.items()
    ])
    targets = (
        spans.select("*", F.explode(wanted).alias("w"))
        .select("*", F.explode(F.array_distinct(F.array(F.floor("w.pos"), F.ceil("w.pos")))).alias("__rank"))
        .where((F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__size")))
    )
    inside = W.partitionBy(*keys, "__bucket").orderBy(value)
    needed = targets.select(*keys, "__bucket", "__from").distinct()
    sliced = placed.join(needed, [*keys, "__bucket"]).withColumn("__hi", F.col("__from") + F.sum("__n").over(
        inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    ))
    hits = sliced.drop("__from").join(targets, [*keys, "__bucket"]).where(
        (F.col("__rank") < F.col("__hi")) & (F.col("__rank") >= F.col("__hi") - F.col("__n"))
    ).select(*keys, F.col("w.name").alias("__name"), F.col("w.pos").alias("__pos"), "__rank",
             F.col(value).cast("double").alias("__value"))
    fraction = F.col("__pos") - F.floor("__pos")
    part = F.struct((F.col("__rank")).alias("r"), F.col("__value").alias("v"))
    ends = hits.groupBy(*keys, "__name", fraction.alias("__frac")).agg(F.min(part).alias("lo"), F.max(part).alias("hi"))
    solved = ends.select(*keys, "__name", (F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * F.col("__frac")).alias("__q"))
    picks = [F.max(F.when(F.col("__name") == n, F.col("__q"))).alias(n) for n in probs]
    return solved.groupBy(*keys).agg(*picks) if keys else solved.agg(*picks)
