"""Scores of classifiers, day folds and result tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from kinetide.operators.ordered import Running, rank_buckets, running


def roc_auc(scored: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """Rank-based AUC per key (ties count half), NULL when a class is missing.

    Rows collapse to one per distinct score; negatives below are a running count over score buckets.
    """
    keys = list(keys)
    tallied = scored.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("long")).alias("__pos"), F.sum(1 - F.col(label).cast("long")).alias("__neg")
    )
    placed = rank_buckets(tallied, keys, score)
    below = running(placed, keys, "__bucket", [score], {"__below": Running("sum", F.col("__neg"), inclusive=False)})
    wins = F.sum(F.col("__pos") * (F.col("__below") + 0.5 * F.col("__neg")))
    pairs = F.sum("__pos").cast("double") * F.sum("__neg")
    return below.groupBy(*keys).agg(
        F.when(pairs > 0, wins / pairs).alias("auc"), F.sum("__pos").alias("n_pos"), F.sum("__neg").alias("n_neg")
    )


def threshold_metrics(scored: DataFrame, keys: Sequence[str], predicted: str = "predicted", label: str = "label") -> DataFrame:
    """f1, precision and recall of the positive class (0 on zero division) with the confusion counts."""
    hit = lambda p, l: F.count(F.when((F.col(predicted) == p) & (F.col(label) == l), 1))
    counts = scored.groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def class_report(scored: DataFrame, keys: Sequence[str], predicted: str = "predicted", label: str = "label") -> DataFrame:
    """precision, recall, f1 and support for each of the two classes."""
    both = scored.select(*keys, F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), predicted, label).select(
        *keys, "class", (F.col(predicted) == F.col("class")).cast("int").alias("__p"), (F.col(label) == F.col("class")).cast("int").alias("__l")
    )
    out = threshold_metrics(both, [*keys, "class"], "__p", "__l")
    return out.select(*keys, "class", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))


def fold_scores(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """auc and f1 per fold, one-class test folds left out. Needs score, predicted, label."""
    aucs = roc_auc(scored, keys).where(F.col("auc").isNotNull()).select(*keys, "auc")
    return aucs.join(threshold_metrics(scored, keys).select(*keys, "f1"), list(keys))


def cv_summary(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population std of auc and f1 over folds."""
    return folds.groupBy(*keys).agg(
        F.count("*").alias("n_folds"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"),
        F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"),
    )


def last_day(df: DataFrame, group: str = "day_str") -> str:
    return df.agg(F.max(group)).first()[0]


def holdout_split(df: DataFrame, group: str = "day_str", test_day: str | None = None) -> DataFrame:
    """Mark rows of the held-out day (default: the last one in text order)."""
    if test_day is not None:
        return df.withColumn("is_test", F.col(group) == F.lit(test_day))
    newest = df.agg(F.max(group).alias(group)).withColumn("is_test", F.lit(True))
    return df.join(F.broadcast(newest), group, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def top_configs(results: DataFrame, k: int = 5) -> DataFrame:
    """Best k configurations by AUC; sanity rows and missing AUCs are left out."""
    ranked = results.where(F.col("mean_auc").isNotNull() & ~F.isnan("mean_auc"))
    if "part" in results.columns:
        ranked = ranked.where(~F.coalesce(F.col("part").startswith("sanity"), F.lit(False)))
    return ranked.orderBy(F.col("mean_auc").desc(), *[c for c in ("config",) if c in results.columns]).limit(k)


def first_best(results: DataFrame, order: str, score: str = "mean_auc") -> DataFrame:
    """First maximum of the score in the given order."""
    return results.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), F.col(order)).limit(1)


def profile(df: DataFrame, group: str = "day_str") -> DataFrame:
    """Rows, positive rate and distinct days of a labelled table."""
    return df.agg(F.count("*").alias("n"), F.avg("label").alias("positive_rate"), F.count_distinct(group).alias("n_days"))


def windows_per_session(windows: DataFrame) -> DataFrame:
    return windows.groupBy("session_id").agg(
        F.count("*").alias("n_windows"), F.sum("label").alias("n_positive"), F.sum(1 - F.col("label")).alias("n_negative")
    )


def coefficient_shift(baseline: DataFrame, informed: DataFrame, k: int = 10) -> DataFrame:
    """Features whose coefficient moved most between two fits (feature, coef)."""
    b, i = baseline.select("feature", F.col("coef").alias("baseline_coef")), informed.select("feature", F.col("coef").alias("informed_coef"))
    return b.join(i, "feature").withColumn("abs_diff", F.abs(F.col("informed_coef") - F.col("baseline_coef"))).orderBy(
        F.col("abs_diff").desc(), "feature").limit(k)


def flip_outcomes(rows: DataFrame) -> DataFrame:
    """Did the flipped prior come closer to the baseline coefficient? rows: feature, baseline, original, flipped."""
    d0, d1 = F.abs(F.col("original") - F.col("baseline")), F.abs(F.col("flipped") - F.col("baseline"))
    verdict = F.when(d1 < d0 * 0.8, "IMPROVED").when(d1 > d0 * 1.2, "WORSENED").otherwise("~unchanged")
    agree = lambda c: F.signum("baseline") == F.signum(c)
    return rows.select(
        "feature", "baseline", "original", "flipped", d0.alias("diff_original"), d1.alias("diff_flipped"),
        verdict.alias("outcome"), agree("original").alias("same_sign_original"), agree("flipped").alias("same_sign_flipped"),
    )


def flip_summary(outcomes: DataFrame) -> DataFrame:
    yz = F.col("feature").startswith("accel_y") | F.col("feature").startswith("accel_z")
    n = lambda c: F.count(F.when(c, 1))
    better, worse = F.col("outcome") == "IMPROVED", F.col("outcome") == "WORSENED"
    return outcomes.agg(
        n(better).alias("n_improved"), n(worse).alias("n_worsened"),
        n(better & yz).alias("accel_yz_improved"), n(worse & ~yz).alias("other_worsened"),
    ).withColumn("helps", (F.col("accel_yz_improved") >= 1) & (F.col("n_worsened") <= 2))
