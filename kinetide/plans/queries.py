"""Registered queries: every operator on the driver's tables, whole tables each time."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetide.operators import (
    alerts, audit, augment, bootstrap, cardiac, cleaning, features, intervals, matching, metrics, models, spectral, validation, windows,
)
from kinetide.operators.ordered import exact_percentiles
from kinetide.plans import tables as T
from kinetide.session import cut_lineage, ensure_checkpoint_dir
from kinetide.sources import packets
from kinetide.sources.recordings import TIMESTAMP_SOURCES
from kinetide.streaming import live, outcomes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every fractional column, so that the order of additions does not show."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields
    ])


STAT_NAMES = [f"x_{s}" for s in features.TIME_STATS]


def lookbacks(spark: SparkSession, sf_dir: str, length: int = T.LOOKBACK) -> DataFrame:
    return windows.lookback_intervals(T.markers(spark, sf_dir), length, T.BUFFER)


def short_windows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return windows.labelled_windows(T.samples(spark, sf_dir), T.markers(spark, sf_dir), T.SHORT, T.BUFFER, **options)


def labelled_features(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Feature table of positives and matched negatives; the day is the date of the window's end.

    Samples are added up in time order: bins and tied scores tell values apart that differ in the last bit.
    """
    found = features.window_features(
        T.samples(spark, sf_dir), short_windows(spark, sf_dir, **options), ["x"], T.SHORT, T.SHORT_LEAST, in_order=True
    )
    return found.withColumn("day_str", T.day_of(F.col("end_t")))


# --- window construction -------------------------------------------------------------------------------------------


@query
def lookback_windows(spark, sf_dir):
    return windows.lookback_intervals(T.markers(spark, sf_dir), T.LOOKBACK, T.BUFFER, shifts=3)


@query
def window_slice(spark, sf_dir):
    sliced = windows.slice_samples(T.samples(spark, sf_dir), lookbacks(spark, sf_dir), T.LOOKBACK)
    return rounded(sliced.groupBy("window_id", "session_id").agg(
        F.count("*").alias("n_samples"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("x").alias("sum_x")))


@query
def time_domain_features(spark, sf_dir):
    found = features.window_features(T.samples(spark, sf_dir), lookbacks(spark, sf_dir), ["x"], T.LOOKBACK, T.LEAST)
    return rounded(found.select("window_id", "session_id", "n_samples", *STAT_NAMES))


@query
def coverage_filter(spark, sf_dir):
    sliced = windows.slice_samples(T.samples(spark, sf_dir).select("session_id", "t"), lookbacks(spark, sf_dir), T.LOOKBACK)
    kept = sliced.groupBy("window_id", "session_id").agg(F.count("*").alias("n_samples")).where(F.col("n_samples") >= T.LEAST)
    return kept.groupBy("session_id").agg(F.count("*").alias("n_windows"), F.sum("n_samples").alias("n_samples"))


@query
def negative_candidates(spark, sf_dir):
    intervals_ = lookbacks(spark, sf_dir, T.SHORT)
    return windows.negative_candidates(T.samples(spark, sf_dir), intervals_, T.SHORT, T.SHORT)


@query
def negative_sample(spark, sf_dir):
    return short_windows(spark, sf_dir).where(F.col("label") == 0)


@query
def all_negatives(spark, sf_dir):
    return short_windows(spark, sf_dir, all_negatives=True)


@query
def labelled_dataset(spark, sf_dir):
    return rounded(labelled_features(spark, sf_dir).select("window_id", "session_id", "day_str", "label", "n_samples", *STAT_NAMES))


@query
def windows_per_session(spark, sf_dir):
    return metrics.windows_per_session(short_windows(spark, sf_dir))


@query
def multi_horizon_features(spark, sf_dir):
    samples = T.samples(spark, sf_dir)
    lengths = {12 * T.HOUR: "w12", 24 * T.HOUR: "w24", 72 * T.HOUR: "w72"}
    vetted = windows.labelled_windows(samples, T.markers(spark, sf_dir), T.LOOKBACK, T.BUFFER)
    anchors = windows.anchored_windows(samples, vetted, list(lengths), {12 * T.HOUR: 1, 24 * T.HOUR: 1, 72 * T.HOUR: T.LEAST})
    per_length = features.window_features(samples, anchors, ["x"], T.LOOKBACK, keep=["length", "anchor_end"])
    return rounded(features.multi_horizon(per_length, STAT_NAMES, lengths))


@query
def dual_window_anchors(spark, sf_dir):
    samples = T.samples(spark, sf_dir)
    vetted = windows.labelled_windows(samples, T.markers(spark, sf_dir), T.LOOKBACK, T.BUFFER)
    both = windows.anchored_windows(samples, vetted, [T.SHORT, T.LOOKBACK], {T.SHORT: T.SHORT_LEAST})
    return both.select("window_id", "session_id", "label", "length", "start_t", "end_t")


@query
def jerk_features(spark, sf_dir):
    found = features.window_features(T.samples(spark, sf_dir), lookbacks(spark, sf_dir), [], T.LOOKBACK, jerk_of=["x"], fs=2.0)
    return rounded(found.select("window_id", "n_samples", *[f"jerk_x_{s}" for s in features.TIME_STATS]))


@query
def trend_features(spark, sf_dir):
    found = features.window_features(T.samples(spark, sf_dir), lookbacks(spark, sf_dir), ["x"], T.LOOKBACK, trend_of=["x"])
    return rounded(found.select("window_id", *STAT_NAMES, "x_trend"))


@query
def dirty_positives(spark, sf_dir):
    samples, marks = T.samples(spark, sf_dir), T.markers(spark, sf_dir)
    found = features.window_features(samples, lookbacks(spark, sf_dir, T.SHORT), ["x"], T.SHORT, T.SHORT_LEAST)
    tagged = windows.dirty_windows(found, marks, T.BUFFER, 2 * T.HOUR, T.SHORT)
    return tagged.select("window_id", "dirty", windows.dirty_weight(F.col("label"), F.col("dirty")).alias("weight"))


@query
def early_segment(spark, sf_dir):
    early = windows.early_segment(lookbacks(spark, sf_dir), T.LOOKBACK, T.LOOKBACK // 2)
    return windows.slice_samples(T.samples(spark, sf_dir), early, T.LOOKBACK).groupBy("window_id").agg(
        F.count("*").alias("n_samples"), F.min("t").alias("first_t"))


@query
def anchor_points(spark, sf_dir):
    bounds = windows.session_bounds(T.samples(spark, sf_dir))
    return windows.anchor_points(bounds, T.markers(spark, sf_dir), T.SHORT, 5 * T.HOUR)


@query
def marker_density(spark, sf_dir):
    ev = T.events(spark, sf_dir)
    return audit.marker_density(ev, T.markers(spark, sf_dir), "event_id", T.DAY)


@query
def context_window(spark, sf_dir):
    around = windows.context_windows(_value_runs(spark, sf_dir), 6 * T.HOUR)
    return windows.slice_samples(T.samples(spark, sf_dir), around, T.DAY, closed_end=True).groupBy(
        "session_id", "start_t", "end_t").agg(F.count("*").alias("n_samples"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


# --- joins ---------------------------------------------------------------------------------------------------------


@query
def session_day_join(spark, sf_dir):
    """Windows get the day of their session's metadata; sessions without any are 'unknown'. Every other session has some here."""
    people = T.table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 2).alias("session_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("day_str"))
    return windows.with_day(lookbacks(spark, sf_dir).select("window_id", "session_id"), people)


@query
def nearest_match(spark, sf_dir):
    rows = T.events(spark, sf_dir).select(
        "day_str", F.col("event_id").alias("idx"), "t", (F.col("event_type") == "error").cast("int").alias("label"))
    return matching.nearest_controls(rows, T.HOUR)


@query
def outcome_match(spark, sf_dir):
    ev = T.events(spark, sf_dir)
    alerts = ev.where(F.col("event_type") == "purchase").select("session_id", "t", F.col("event_id").alias("alert_idx"))
    marks = ev.where(F.col("event_type") == "error").select("session_id", "t", F.col("event_id").alias("outcome_id"), F.col("event_type").alias("event"))
    return matching.match_outcomes(alerts, marks, 24 * T.HOUR, T.DAY)


@query
def positional_zip(spark, sf_dir):
    ev, looks = T.events(spark, sf_dir), lookbacks(spark, sf_dir, T.BEAT_SPAN)
    def stream(kind, name):
        part = ev.where(F.col("event_type") == kind).select("session_id", "t", F.col("value").alias(name))
        return windows.slice_samples(part, looks, T.BEAT_SPAN).select("window_id", "t", name)
    zipped = matching.positional_zip(stream("click", "a"), stream("view", "b"), least=3)
    return rounded(zipped.groupBy("window_id").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("dot")))


@query
def source_override(spark, sf_dir):
    names = T.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("exp-"), F.col("s_suppkey").cast("string")).alias("name"))
    mapping = spark.createDataFrame(list(TIMESTAMP_SOURCES.items()), "name string, source string")
    return matching.coalesce_override(names, mapping, "name").select("s_suppkey", "name", "source")


@query
def resume_antijoin(spark, sf_dir):
    """Orders without any returned line: what is left to do after the recorded work."""
    todo = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    done = T.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return bootstrap.remaining(todo, done, ["o_orderkey"])


# --- ordered analytics and intervals -------------------------------------------------------------------------------


@query
def monotonic_audit(spark, sf_dir):
    return audit.monotonic_audit(T.shipments(spark, sf_dir), "file_offset", T.SHIPMENT_BUCKET, wrap=3600, tolerance=1500)


@query
def anomaly_sample(spark, sf_dir):
    return audit.anomaly_sample(T.shipments(spark, sf_dir), "file_offset", T.SHIPMENT_BUCKET)


@query
def duplicate_audit(spark, sf_dir):
    return audit.duplicate_audit(T.shipments(spark, sf_dir), "file_offset", T.SHIPMENT_BUCKET, ["l_returnflag", "l_linestatus"])


def _value_runs(spark, sf_dir):
    flagged = intervals.flag_above(T.events(spark, sf_dir).select("session_id", "t", "value"), "value", 1.0)
    return intervals.runs(flagged, F.col("value"), 7 * T.DAY)


@query
def threshold_flags(spark, sf_dir):
    return intervals.flag_above(T.events(spark, sf_dir).select("session_id", "event_id", "value"), "value", 3.0)


@query
def threshold_runs(spark, sf_dir):
    return _value_runs(spark, sf_dir)


@query
def merge_runs(spark, sf_dir):
    merged = intervals.merge_close(checkpointed(_value_runs(spark, sf_dir)), 12 * T.HOUR, 7 * T.DAY)
    return intervals.at_least(merged, 6 * T.HOUR)


@query
def rolling_window(spark, sf_dir):
    ev = T.events(spark, sf_dir).select("session_id", "event_id", "t", "x")
    return rounded(intervals.rolling_lookback(ev, T.LOOKBACK, {"n": F.count("*"), "avg_x": F.avg("x"), "max_x": F.max("x")}))


@query
def session_median(spark, sf_dir):
    ev = T.events(spark, sf_dir)
    return rounded(exact_percentiles(ev, ["event_type"], "value", {"p025": 0.025, "median": 0.5, "p975": 0.975}))


@query
def manifest_pivot(spark, sf_dir):
    ev = T.events(spark, sf_dir).withColumnRenamed("event_type", "kind")
    return audit.session_manifest(ev, ["click", "error", "purchase", "signup", "view"])


@query
def name_clock_check(spark, sf_dir):
    """Names like 2024-01-05-7-89pm made from each event's date, hour and key."""
    ev = T.events(spark, sf_dir)
    name = F.concat(F.col("day_str"), F.lit("-"), (F.pmod(F.floor(F.col("t") / T.HOUR), F.lit(24))).cast("string"), F.lit("-"),
                    F.get_json_object("props", "$.k"), F.when(F.col("event_type") == "view", "").otherwise("pm_1"))
    return audit.name_clock_check(ev.select("event_id", name.alias("session_id"))).groupBy(
        "session_id", "pattern_match", "parsed_hour", "parsed_minute", "valid_clock_time").agg(F.count("*").alias("n"))


@query
def mm_ss_parse(spark, sf_dir):
    ev = T.events(spark, sf_dir)
    return ev.select("event_id", matching.minutes_seconds(F.col("value"), F.floor(F.col("t") / 1000)).alias("event_ms"))


# --- cardiac features ----------------------------------------------------------------------------------------------


def _beats(spark, sf_dir):
    looks = lookbacks(spark, sf_dir, T.BEAT_SPAN)
    return windows.slice_samples(T.samples(spark, sf_dir), looks, T.BEAT_SPAN).select(
        "window_id", (F.col("t") * F.lit(T.BEAT_UNIT)).alias("t"))


@query
def gapped_ibi(spark, sf_dir):
    return rounded(cardiac.inter_beat_intervals(_beats(spark, sf_dir)), 3)


@query
def ectopic_rejection(spark, sf_dir):
    return rounded(cardiac.reject_ectopic(cardiac.inter_beat_intervals(_beats(spark, sf_dir)), fraction=0.6), 3)


def _heart(spark, sf_dir):
    return cardiac.heart_features(cardiac.reject_ectopic(cardiac.inter_beat_intervals(_beats(spark, sf_dir)), fraction=0.6))


@query
def hr_trend(spark, sf_dir):
    return rounded(_heart(spark, sf_dir).select("window_id", "n_ibis", "raw_hr_mean", "plausible_hr", "n_valid", "hr_trend_mean", "hr_trend_slope"), 4)


@query
def rmssd_sdnn(spark, sf_dir):
    return rounded(_heart(spark, sf_dir).select("window_id", "rmssd_clean", "sdnn_clean"), 4)


@query
def quality_funnel(spark, sf_dir):
    beats = _beats(spark, sf_dir)
    segments = beats.groupBy("window_id").agg(F.count("*").alias("n_samples"))
    return cardiac.quality_funnel(cardiac.quality_record(segments, beats))


# --- cleaning, scaling, metrics ------------------------------------------------------------------------------------


@query
def median_impute(spark, sf_dir):
    """Drop the all-missing column, fill the gaps of the cardiac features with medians over all rows."""
    names = ["hr_trend_mean", "hr_trend_slope", "sdnn_clean", "never"]
    gaps = _heart(spark, sf_dir).withColumn("never", F.lit(None).cast("double")).select("window_id", *names)
    cleaned, kept = cleaning.clean(gaps, names)
    return rounded(cleaned.select("window_id", *kept), 4)


@query
def fold_median_impute(spark, sf_dir):
    """Medians of the training rows only: fold k holds out the windows whose marker id leaves k when divided by 3."""
    names = ["hr_trend_mean", "sdnn_clean"]
    part = F.split("window_id", ":")[1].cast("long") % 3
    rows = _heart(spark, sf_dir).select("window_id", *names, part.alias("part"))
    spread = rows.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("is_train", F.col("part") != F.col("fold"))
    return rounded(cleaning.clean_by_training_rows(spread, names).select("window_id", "fold", *names), 4)


@query
def standardize(spark, sf_dir):
    rows = labelled_features(spark, sf_dir)
    params = {r.feature: r for r in cleaning.scaler(rows, STAT_NAMES).collect()}  # one row per feature
    scaled = cleaning.scale_expressions(STAT_NAMES, {n: params[n]["mean"] for n in STAT_NAMES}, {n: params[n]["scale"] for n in STAT_NAMES})
    return rounded(rows.select("window_id", *[e.alias(n) for n, e in scaled.items()]))


@query
def fold_scalers(spark, sf_dir):
    return rounded(cleaning.fold_scalers(labelled_features(spark, sf_dir), STAT_NAMES, "day_str"), 7)


@query
def class_weights(spark, sf_dir):
    rows = T.events(spark, sf_dir).select("day_str", (F.col("event_type") == "error").cast("int").alias("label"))
    return rounded(cleaning.class_weights(rows, ["day_str"]))


def _scored_events(spark, sf_dir):
    """Events scored by their value, labelled by 'error', predicted above 50."""
    return T.events(spark, sf_dir).select(
        "day_str", F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"),
        (F.col("value") > 50).cast("int").alias("predicted"))


@query
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(_scored_events(spark, sf_dir), ["day_str"]))


@query
def roc_auc_total(spark, sf_dir):
    return rounded(metrics.roc_auc(_scored_events(spark, sf_dir), []))


@query
def prf_metrics(spark, sf_dir):
    return rounded(metrics.threshold_metrics(_scored_events(spark, sf_dir), ["day_str"]))


@query
def class_report(spark, sf_dir):
    return rounded(metrics.class_report(_scored_events(spark, sf_dir), ["day_str"]))


@query
def cv_summary(spark, sf_dir):
    by_day = metrics.fold_scores(_scored_events(spark, sf_dir), ["day_str"])
    return rounded(metrics.cv_summary(by_day, []))


@query
def topk_configs(spark, sf_dir):
    by_day = metrics.fold_scores(_scored_events(spark, sf_dir), ["day_str"])
    return rounded(metrics.top_configs(by_day.select(F.col("day_str").alias("config"), F.col("auc").alias("mean_auc")), 5))


@query
def class_histogram(spark, sf_dir):
    return features.class_histogram(labelled_features(spark, sf_dir), ["x_mean", "x_max"])


@query
def holdout_split(spark, sf_dir):
    marked = metrics.holdout_split(labelled_features(spark, sf_dir))
    return marked.groupBy("is_test", "label").agg(F.count("*").alias("n"), F.max("day_str").alias("last_day"))


@query
def dataset_profile(spark, sf_dir):
    return rounded(metrics.profile(labelled_features(spark, sf_dir)))


@query
def flip_outcomes(spark, sf_dir):
    """Per day: does the negated mean of clicks come closer to the overall mean than the mean itself?"""
    ev = T.events(spark, sf_dir)
    rows = ev.groupBy(F.concat(F.lit("accel_y_"), "day_str").alias("feature")).agg(
        F.avg("x").alias("baseline"), F.avg(F.when(F.col("event_type") == "click", F.col("x"))).alias("original"))
    return rounded(metrics.flip_outcomes(rows.withColumn("flipped", -F.col("original"))), 5)


@query
def flip_summary(spark, sf_dir):
    return metrics.flip_summary(QUERIES["flip_outcomes"](spark, sf_dir))


@query
def coefficient_shift(spark, sf_dir):
    ev = T.events(spark, sf_dir)
    means = lambda kind: ev.where(F.col("event_type") == kind).groupBy(F.col("day_str").alias("feature")).agg(F.avg("x").alias("coef"))
    return rounded(metrics.coefficient_shift(means("click"), means("view")))


@query
def day_set_difference(spark, sf_dir):
    """Days of a user that have events of one kind only."""
    of = lambda kind: T.events(spark, sf_dir).where(F.col("event_type") == kind).select(F.concat_ws(":", "session_id", "day_str").alias("day_str"))
    return bootstrap.same_days(of("click"), of("view"))


@query
def matched_population(spark, sf_dir):
    """Windows on which a 24 h and a 72 h extraction of the maximum disagree (they should where older peaks exist)."""
    samples = T.samples(spark, sf_dir)
    def side(length):
        found = features.window_features(samples, lookbacks(spark, sf_dir, length), ["x"], length)
        return found.select("window_id", "label", T.day_of(F.col("end_t")).alias("day_str"), "x_max")
    return bootstrap.population_mismatch(side(T.SHORT), side(T.LOOKBACK), ["x_max"])


# --- bootstrap -----------------------------------------------------------------------------------------------------

REPS = 200


@query
def day_draws(spark, sf_dir):
    return bootstrap.day_draws(T.events(spark, sf_dir), REPS)


@query
def resample_folds(spark, sf_dir):
    return bootstrap.resample_folds(bootstrap.day_draws(T.embeddings(spark, sf_dir)[0], REPS))


def _value_replicates(spark, sf_dir, sign: float = 1.0, kind: str = "error"):
    """Replicate scores without refit: mean over each replicate's drawn days of the day's AUC of value against `kind`."""
    scored = T.events(spark, sf_dir).select("day_str", (F.col("value") * sign).alias("score"), (F.col("event_type") == kind).cast("int").alias("label"))
    by_day = metrics.roc_auc(scored, ["day_str"]).select(F.col("day_str").alias("day"), "auc")
    draws = bootstrap.day_draws(T.events(spark, sf_dir), REPS).select("rep", "day").distinct()
    return draws.join(by_day, "day").groupBy("rep").agg(F.avg("auc").alias("mean_auc"))


@query
def bootstrap_ci(spark, sf_dir):
    return rounded(bootstrap.interval(_value_replicates(spark, sf_dir)))


@query
def paired_diff(spark, sf_dir):
    return rounded(bootstrap.paired_difference(_value_replicates(spark, sf_dir), _value_replicates(spark, sf_dir, kind="click")))


# --- models --------------------------------------------------------------------------------------------------------


@query
def naive_bayes_cv(spark, sf_dir):
    rows, names = T.embeddings(spark, sf_dir)
    return rounded(metrics.fold_scores(validation.bayes(rows, names), ["model_id"]))


@query
def logistic_cv(spark, sf_dir):
    rows, names = T.embeddings(spark, sf_dir)
    return rounded(metrics.fold_scores(validation.logistic(rows.persist(), names), ["model_id"]))


@query
def weighted_logistic_cv(spark, sf_dir):
    """Row weights 0.5 for the first two labels, as for down-weighted positives."""
    rows, names = T.embeddings(spark, sf_dir)
    weighted = rows.withColumn("w", F.when(F.col("label") == 1, 0.5).otherwise(1.0)).persist()
    return rounded(metrics.fold_scores(validation.logistic(weighted, names, weight="w"), ["model_id"]))


@query
def window_logistic_cv(spark, sf_dir):
    """The whole path: windows, features, leave-one-day-out fits, scores."""
    rows = checkpointed(labelled_features(spark, sf_dir))
    return rounded(metrics.fold_scores(validation.logistic(rows, STAT_NAMES), ["model_id"]))


@query
def all_negatives_cv(spark, sf_dir):
    rows = checkpointed(labelled_features(spark, sf_dir, all_negatives=True))
    return rounded(validation.evaluate(validation.logistic(rows, STAT_NAMES)))


@query
def window_bayes_cv(spark, sf_dir):
    rows = checkpointed(labelled_features(spark, sf_dir))
    return rounded(metrics.fold_scores(validation.bayes(rows, STAT_NAMES), ["model_id"]))


@query
def elastic_net_cv(spark, sf_dir):
    rows = checkpointed(labelled_features(spark, sf_dir)).withColumn("week", F.substring("day_str", 1, 9))
    scored, choice = validation.elastic_net(rows, STAT_NAMES, group="week")
    return rounded(metrics.fold_scores(scored, ["model_id"]).join(choice, "model_id"))


@query
def conditional_logit_cv(spark, sf_dir):
    rows = checkpointed(validation.by_time(labelled_features(spark, sf_dir), T.HOUR))
    return rounded(metrics.fold_scores(validation.conditional(rows, STAT_NAMES, T.HOUR, t="end_t"), ["model_id"]))


@query
def population_prior(spark, sf_dir):
    """L2 fit over all rows with its scaler, and Wald tests of the unpenalised fit."""
    rows, names = T.embeddings(spark, sf_dir)
    rows = rows.persist()
    prior = validation.fit_all(rows, names, C=1.0, balanced=False).coefficients(spark)
    tests = models.wald_tests(validation.fit_all(rows, names, C=1.0, balanced=False, l2=0.0))
    table = spark.createDataFrame([(t["feature"], t["se"], t["p"]) for t in tests], "feature string, se double, p double")
    return rounded(prior.join(table, "feature").drop("model_id"))


@query
def informed_prior_cv(spark, sf_dir):
    """Prior from the other half of the labels' vectors, all penalties at once."""
    rows, names = T.embeddings(spark, sf_dir)
    rows = rows.persist()
    fitted = validation.fit_all(rows, names, C=1.0, balanced=False)
    scored = validation.informed(rows, names, (fitted.coef / fitted.scale)[0])
    return rounded(validation.evaluate(scored, ["lam"]))


def _one_feature(spark, sf_dir):
    """Window table with one feature, small enough to have its fits written out in SQL."""
    return checkpointed(labelled_features(spark, sf_dir).select("window_id", "day_str", "label", "end_t", "x_mean"))


def _fit_table(spark, rows, **options):
    moments, design = validation.folds(rows, ["x_mean"])
    fitted = models.fit_logistic(rows, ["x_mean"], design, moments, **options)
    table = [(i, float(a), float(c[0])) for i, a, c in zip(design.ids, fitted.intercept, fitted.coef)]
    return rounded(spark.createDataFrame(table, "fold string, intercept double, coef double"))


@query
def logistic_fit(spark, sf_dir):
    """Coefficients of every leave-one-day-out fit (L2, balanced)."""
    return _fit_table(spark, _one_feature(spark, sf_dir), C=validation.BASELINE_C, balanced=True)


@query
def lasso_fit(spark, sf_dir):
    """The same with half of the penalty absolute."""
    return _fit_table(spark, _one_feature(spark, sf_dir), C=0.1, l2=0.5, l1=0.5, balanced=True)


@query
def informed_fit(spark, sf_dir):
    """The same pulled toward a raw-unit prior of 0.02 with strength 20."""
    return _fit_table(spark, _one_feature(spark, sf_dir), l2=40.0, prior_raw=np.array([0.02]))


@query
def logistic_fold_scores(spark, sf_dir):
    rows = _one_feature(spark, sf_dir)
    scored = validation.logistic(rows, ["x_mean"], C=1.0).persist()
    mean = scored.groupBy("model_id").agg(F.avg("score").alias("mean_score"))
    return rounded(metrics.fold_scores(scored, ["model_id"]).join(mean, "model_id"))


@query
def conditional_fold_scores(spark, sf_dir):
    rows = checkpointed(validation.by_time(_one_feature(spark, sf_dir), T.HOUR))
    scored = validation.conditional(rows, ["x_mean"], T.HOUR, t="end_t").persist()
    mean = scored.groupBy("model_id").agg(F.avg("score").alias("mean_score"))
    return rounded(metrics.fold_scores(scored, ["model_id"]).join(mean, "model_id"))


@query
def wald_errors(spark, sf_dir):
    """Unpenalised fit over all windows with its standard error."""
    test = models.wald_tests(validation.fit_all(_one_feature(spark, sf_dir), ["x_mean"], C=1.0, balanced=False, l2=0.0))[0]
    return rounded(spark.createDataFrame([(test["coef"], test["se"])], "coef double, se double"))


@query
def holdout_eval(spark, sf_dir):
    rows, names = T.embeddings(spark, sf_dir)
    rows = rows.persist()
    return rounded(validation.holdout_report(rows, validation.holdout(rows, names)))


@query
def rf_cv(spark, sf_dir):
    rows, names = T.embeddings(spark, sf_dir)
    return rounded(metrics.fold_scores(validation.trees(rows, names, validation.forest, balanced=True, key=F.col("vec_id")), ["model_id"]))


@query
def gbt_cv(spark, sf_dir):
    rows, names = T.embeddings(spark, sf_dir)
    return rounded(metrics.fold_scores(validation.trees(rows, names, validation.boosting, balanced=False), ["model_id"]))


@query
def bayes_bootstrap(spark, sf_dir):
    """Day-block replicates of naive Bayes with multiplicity-weighted moments."""
    rows, names = T.embeddings(spark, sf_dir)
    draws = bootstrap.day_draws(rows, 50)
    return rounded(bootstrap.replicates(rows.persist(), names, draws, bootstrap.bayes_scorer()))


@query
def logistic_bootstrap(spark, sf_dir):
    rows, names = T.embeddings(spark, sf_dir)
    draws = bootstrap.day_draws(rows, 50)
    return rounded(bootstrap.interval(bootstrap.replicates(rows.persist(), names, draws, bootstrap.logistic_scorer(names))))


# --- signals -------------------------------------------------------------------------------------------------------


@query
def fft_features(spark, sf_dir):
    arrays = spectral.window_arrays(T.samples(spark, sf_dir), lookbacks(spark, sf_dir), ["x"], T.LOOKBACK)
    found = spectral.array_features(arrays, ["x"], fs=16.0)
    return found.select("window_id", "n_samples", F.round("x_dominant_freq", 6).alias("x_dominant_freq"),
                        F.round("x_power_0_5hz", 2).alias("x_power_0_5hz"), F.round("x_power_5_15hz", 2).alias("x_power_5_15hz"))


@query
def feature_parity(spark, sf_dir):
    """Aggregates and array code agree on the time-domain features of every window."""
    samples, looks = T.samples(spark, sf_dir), lookbacks(spark, sf_dir)
    native = features.window_features(samples, looks, ["x"], T.LOOKBACK)
    arrays = spectral.array_features(spectral.window_arrays(samples, looks, ["x"], T.LOOKBACK), ["x"], 16.0, with_time_stats=True)
    return features.max_difference(native.select("window_id", *STAT_NAMES), arrays.select("window_id", *STAT_NAMES), STAT_NAMES).select(
        "feature", (F.col("max_abs_diff") < 1e-9).alias("agrees"))


@query
def ppg_hr(spark, sf_dir):
    """Pulse features of the value series of each long window (25 ms of millisecond clock per sample)."""
    ev = T.events(spark, sf_dir).select("session_id", "t", F.col("value").alias("ppg_ir"), "x")
    arrays = spectral.window_arrays(ev, lookbacks(spark, sf_dir, T.BEAT_SPAN), ["x", "ppg_ir"], T.BEAT_SPAN)
    return rounded(spectral.array_features(arrays, ["x"], 50.0, pulse=True).select("window_id", *spectral.PULSE_STATS), 4)


@query
def beat_detection(spark, sf_dir):
    ev = T.events(spark, sf_dir).select("session_id", "t", F.col("value").alias("ppg_ir"))
    return spectral.beats(spectral.window_arrays(ev, lookbacks(spark, sf_dir, T.BEAT_SPAN), ["ppg_ir"], T.BEAT_SPAN))


@query
def emg_envelope(spark, sf_dir):
    ev = T.events(spark, sf_dir).select("session_id", "t", F.col("value").cast("int").alias("emg_raw"))
    return rounded(intervals.envelope(ev, "emg_raw", 7 * T.DAY).select("session_id", "t", "envelope"), 4)


@query
def emg_envelope_3hz(spark, sf_dir):
    """The envelope with a lower cut-off and order, in blocks of 20 samples whose states are chained."""
    ev = T.events(spark, sf_dir).select("session_id", "t", F.col("value").cast("int").alias("emg_raw"))
    return rounded(intervals.envelope(ev, "emg_raw", 7 * T.DAY, chunk=20, lowpass_hz=3.0, lowpass_order=2).select("session_id", "t", "envelope"), 4)


@query
def emg_candidates(spark, sf_dir):
    ev = T.events(spark, sf_dir).select("session_id", "t", F.col("value").cast("int").alias("emg_raw"))
    return intervals.find_candidates(ev, factor=1.02, min_gap=12 * T.HOUR, min_duration=6 * T.HOUR, width=7 * T.DAY)


@query
def augmented_windows(spark, sf_dir):
    """Originals and altered copies of every lookback window, with features taken again from each copy."""
    arrays = spectral.window_arrays(T.samples(spark, sf_dir), lookbacks(spark, sf_dir), ["x"], T.LOOKBACK, T.LEAST)
    copies = augment.augment(arrays, ["x"], list(augment.AUGMENTATIONS))
    found = spectral.array_features(copies, ["x"], 16.0, with_time_stats=True)
    return rounded(found.groupBy("augmentation").agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in STAT_NAMES]), 3)


@query
def packet_decode(spark, sf_dir):
    """Events written as binary frames with stray bytes between them, one recording per user and day, and read back."""
    ev = T.events(spark, sf_dir)
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    framed = packets.encode_imu(ev.select(
        F.concat_ws("_", F.col("session_id").cast("string"), "day_str").alias("session_id"), "t",
        F.pmod(F.floor(F.col("t") / 1000), F.lit(1 << 32)).alias("timestamp_ms"),
        F.floor(F.col("x") * 10).alias("accel_x"), (e % 30000).alias("accel_y"), (-(e % 30000)).alias("accel_z"),
        k.alias("gyro_x"), (-k).alias("gyro_y"), F.length("event_type").alias("gyro_z"),
        F.floor(F.col("value") * 1000).alias("ppg_ir"), e.alias("ppg_red"),
        (F.lit(0x3F800000) + (e % 8) * (1 << 20)).alias("ambient_bits"), (F.lit(0x3F800000) + (e % 4) * (1 << 21)).alias("object_bits"),
    ))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "frame"))), lambda s: F.concat(F.lit("AA01"), F.hex(s["frame"]))), "00")
    blobs = framed.groupBy("session_id").agg(F.unhex(F.concat(text, F.lit("AA0101FF"))).alias("content"))
    return packets.decode_blobs(blobs, ["imu"]).select(
        "session_id", "file_offset", "timestamp_ms", "accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z", "ppg_ir", "ppg_red",
        F.col("ambient_c").cast("double").alias("ambient_c"), F.col("object_c").cast("double").alias("object_c"))


# --- live scoring --------------------------------------------------------------------------------------------------

TOY_MODEL = {  # a fixed linear model of two window features
    "names": ["x_mean", "x_max"], "mean": [0.0, 100.0], "scale": [20.0, 50.0], "coef": [1.0, 0.5], "intercept": 0.1,
    "medians": {"x_mean": 0.0, "x_max": 100.0},
}


@query
def cooldown_alerts(spark, sf_dir):
    evals = T.events(spark, sf_dir).select("session_id", F.col("event_id").alias("eval_id"), "t", (F.col("value") / 100.0).alias("probability"))
    return alerts.cooldown_alerts(evals, 24 * T.HOUR, threshold=0.3).select("session_id", "eval_id", "alert_fired", "suppressed_by_cooldown")


@query
def live_scoring(spark, sf_dir):
    """Recorded feed: daily evaluations of the closed 72 h window, coverage gate, linear score."""
    samples = T.samples(spark, sf_dir)
    looks = alerts.live_windows(alerts.evaluation_ticks(samples, T.DAY), T.LOOKBACK)
    found = features.window_features(samples, looks, ["x"], T.LOOKBACK, T.LEAST)
    return rounded(live.score_rows(found, TOY_MODEL).select("window_id", "session_id", "n_samples", "probability"))


@query
def sliding_features(spark, sf_dir):
    ev = T.events(spark, sf_dir).select("session_id", F.timestamp_micros("t").alias("ts"), "x")
    found = live.sliding_features(ev, "ts", ["x"], "72 hours", "24 hours", least=T.LEAST)
    return rounded(found.withColumn("window_end", F.unix_micros("window_end")))


def _event_stream(spark, sf_dir):
    raw = spark.readStream.schema(T.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("user_id").alias("session_id"), T.micros("ts").alias("t"), "event_type", (F.col("value") - F.lit(50.0)).alias("x"))


def _run_stream(spark, stream):
    """Run a stream over what is there and read its output back."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    running = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query
def stream_sliding_features(spark, sf_dir):
    ev = _event_stream(spark, sf_dir).select("session_id", F.timestamp_micros("t").alias("ts"), "x")
    found = _run_stream(spark, live.sliding_features(ev, "ts", ["x"], "72 hours", "24 hours", "10 seconds", T.LEAST))
    return rounded(found.withColumn("window_end", F.unix_micros("window_end")))


@query
def stream_alerts(spark, sf_dir):
    """The event stream through the stateful scorer; 'error' events come in as outcome marks."""
    feed = _event_stream(spark, sf_dir).select(
        F.col("session_id").cast("string").alias("session_id"), F.floor(F.col("t") / 1000).alias("t"),
        F.when(F.col("event_type") == "error", "missed_pick").alias("event"), "x")
    hour = 3_600_000
    def vector(t, v, end):
        return {"x_mean": float(v["x"].mean()), "x_max": float(v["x"].max())}
    return _run_stream(spark, live.live_alerts(feed, TOY_MODEL, vector, ["x"], 72 * hour, 6 * hour, T.LEAST, 0.5, 24 * hour, 24 * hour)).drop("n_late")


@query
def stream_outcomes(spark, sf_dir):
    """Purchases as alerts, errors as marks, joined as streams; a last row far in the future lets every mark leave."""
    ev = _events_by_id(spark, sf_dir)
    folder = f"{ensure_checkpoint_dir(spark)}/closing-{uuid.uuid4().hex}"
    kinds = spark.createDataFrame([("purchase",), ("error",)], "event_type string")
    closing = {"session_id": F.lit(-1), "t": F.lit(4_000_000_000_000_000), "event_id": F.lit(None), "event_type": F.col("event_type")}
    kinds.select(*(closing[f.name].cast(f.dataType).alias(f.name) for f in ev.schema)).write.parquet(folder)
    both = ev.unionByName(spark.readStream.schema(ev.schema).parquet(folder))
    alerts_ = both.where("event_type = 'purchase'").withColumnRenamed("event_id", "alert_idx")
    marks = both.where("event_type = 'error'").select("session_id", "t", F.col("event_id").alias("outcome_id"), F.col("event_type").alias("event"))
    return _run_stream(spark, outcomes.stream_outcomes(alerts_, marks, 24 * T.HOUR, 240 * T.HOUR, T.HOUR, per_second=1_000_000)).where("outcome_id is not null")


def _events_by_id(spark, sf_dir):
    raw = spark.readStream.schema(T.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("user_id").alias("session_id"), T.micros("ts").alias("t"), "event_id", "event_type")


def checkpointed(df: DataFrame) -> DataFrame:
    """Feature tables are read many times by the fits, so they are written once."""
    return cut_lineage(df)
