"""Missing values, scaling and class weights of feature tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinetide.operators.ordered import exact_percentiles


def melt(df: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long form: ids, feature, value."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*ids, F.explode(pairs).alias("__p")).select(*ids, "__p.feature", "__p.value")


def empty_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Features without a single value: one aggregate row, read by the driver because it changes the schema."""
    counts = df.agg(*[F.count(n).alias(n) for n in names]).first()
    return [n for n in names if counts[n] == 0]


def feature_medians(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact medians in long form (keys, feature, median)."""
    return exact_percentiles(melt(df, keys, names), [*keys, "feature"], "value", {"median": 0.5})


def fill_missing(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(m)) for n, m in medians.items()})


def clean(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Drop all-missing features, then fill the rest with medians over all rows."""
    gone = empty_columns(df, names)
    kept = [n for n in names if n not in gone]
    if not kept:
        return df.drop(*gone), kept
    medians = {r.feature: r["median"] for r in feature_medians(df, kept).collect()}  # one number per feature
    return fill_missing(df.drop(*gone), medians), kept


def clean_by_training_rows(df: DataFrame, names: Sequence[str], fold: str = "fold", is_train: str = "is_train") -> DataFrame:
    """Fill with the medians of each fold's training rows; a feature empty in training becomes 0 for its fold.

    A constant feature has no weight in any fit, so 0 stands for the dropped column while the schema stays one.
    """
    wide = feature_medians(df.where(F.col(is_train)), names, [fold]).groupBy(fold).agg(
        *[F.max(F.when(F.col("feature") == n, F.col("median"))).alias(f"__m_{n}") for n in names]
    )
    joined = df.join(wide, fold, "left")
    filled = {
        n: F.when(F.col(f"__m_{n}").isNull(), 0.0).otherwise(F.coalesce(F.col(n).cast("double"), F.col(f"__m_{n}"))) for n in names
    }
    return joined.withColumns(filled).drop(*[f"__m_{n}" for n in names])


def align_row(df: DataFrame, names: Sequence[str], medians: dict[str, float], ids: Sequence[str]) -> DataFrame:
    """Trained column order; a missing column or value takes the frozen training median."""
    cell = lambda n: F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")), F.lit(medians[n])) if n in df.columns else F.lit(medians[n])
    return df.select(*ids, *[cell(n).alias(n) for n in names])


def scaler(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population std per feature (1 for a constant feature), long form."""
    return melt(df, [], names).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    ).select("feature", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("scale"))


def scale_expressions(names: Sequence[str], means: dict[str, float], scales: dict[str, float]) -> dict[str, Column]:
    return {n: (F.col(n) - F.lit(means[n])) / F.lit(scales[n]) for n in names}


def fold_scalers(df: DataFrame, names: Sequence[str], group: str) -> DataFrame:
    """Scaler of each leave-one-group-out training set: fold, feature, n, mean, scale.

    One pass of per-group sums; a training set's sums are the total less its own group, taken around the overall
    mean so that the difference loses no precision.
    """
    long = melt(df, [group], names)
    centre = long.groupBy("feature").agg(F.avg("value").alias("__c"))
    shifted = long.join(F.broadcast(centre), "feature").withColumn("__d", F.col("value") - F.col("__c"))
    per_group = shifted.groupBy(group, "feature", "__c").agg(
        F.count("__d").alias("n"), F.sum("__d").alias("s"), F.sum(F.col("__d") * F.col("__d")).alias("q")
    )
    total = per_group.groupBy("feature").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"), F.sum("q").alias("q_all"))
    rest = per_group.join(F.broadcast(total), "feature").select(
        F.col(group).alias("fold"), "feature", (F.col("n_all") - F.col("n")).alias("n"),
        "__c", (F.col("s_all") - F.col("s")).alias("s"), (F.col("q_all") - F.col("q")).alias("q"),
    ).where(F.col("n") > 0)
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    return rest.select("fold", "feature", "n", (F.col("__c") + mean).alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("scale"))


def class_weights(df: DataFrame, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Balanced weight n / (2 n_class) per key and class."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n_class"))
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum("n_class").alias("n"))
        both = counts.join(totals, list(keys))
    else:
        both = counts.withColumn("__all", F.lit(0)).join(
            counts.agg(F.sum("n_class").alias("n")).withColumn("__all", F.lit(0)), "__all").drop("__all")
    return both.select(*keys, label, "n_class", (F.col("n") / (2.0 * F.col("n_class"))).alias("weight"))
