"""Day-block bootstrap: shared draws, replicate scores, intervals and paired differences."""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from kinetide.operators import forests, metrics, models

REPS_PER_CHUNK = 20


def day_draws(days: DataFrame, n_rep: int, seed: int = 42, day: str = "day_str") -> DataFrame:
    """n_rep x n_days uniform draws with replacement: rep, slot, day. Drawn by md5, so every run and configuration shares them."""
    listed = days.select(F.col(day).cast("string").alias("day")).distinct()
    numbered = listed.withColumn("pos", F.row_number().over(W.orderBy("day")) - 1)  # distinct days only
    total = listed.agg(F.count("*").alias("n_days"))
    slots = (
        total.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n_days").cast("int") - 1)))
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("slot").cast("string")))
    picked = slots.withColumn("pos", (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.col("n_days")).cast("int"))
    return picked.join(numbered, "pos").select("rep", "slot", "day")


def resample_folds(draws: DataFrame) -> DataFrame:
    """rep, test_day, train_key: each distinct drawn day is tested once against the other drawn days with multiplicity.

    The key names the training multiset, so that equal (test_day, multiset) pairs are fitted once.
    """
    counts = draws.groupBy("rep", "day").agg(F.count("*").alias("mult"))
    others = F.collect_list(F.struct("day", "mult")).over(W.partitionBy("rep"))
    rest = F.array_sort(F.filter(F.col("drawn"), lambda s: s["day"] != F.col("day")))
    text = F.concat_ws(",", F.transform(rest, lambda s: F.concat_ws("*", s["day"], s["mult"].cast("string"))))
    return (
        counts.withColumn("drawn", others).where(F.size("drawn") >= 2)
        .select("rep", F.col("day").alias("test_day"), text.alias("train_key"))
    )


def _designs(plan: DataFrame, groups: Sequence[str]) -> models.Design:
    at = {g: i for i, g in enumerate(groups)}
    found = plan.select("test_day", "train_key").distinct().orderBy("test_day", "train_key").collect()  # models of one chunk
    weights = np.zeros((len(found), len(groups)))
    for i, row in enumerate(found):
        for part in row.train_key.split(","):
            name, mult = part.rsplit("*", 1)
            if name in at:
                weights[i, at[name]] = int(mult)
    return models.Design([f"{r.test_day}|{r.train_key}" for r in found], list(groups), weights, [r.test_day for r in found])


Scorer = Callable[[DataFrame, models.Moments, models.Design], DataFrame]


def logistic_scorer(names: Sequence[str], C: float = 0.01, group: str = "day_str", prior_raw=None, lam: float | None = None) -> Scorer:
    """Refit of the baseline (or, with a prior, of the informed model) for a batch of resamples."""
    def run(rows: DataFrame, moments: models.Moments, design: models.Design) -> DataFrame:
        if prior_raw is None:
            fitted = models.fit_logistic(rows, names, design, moments, C=C, balanced=True, group=group, tol=1e-7)
        else:
            fitted = models.fit_logistic(rows, names, design, moments, l2=2.0 * lam, prior_raw=np.asarray(prior_raw, float), group=group, tol=1e-7)
        return models.score_linear(rows, fitted, group=group)
    return run


def bayes_scorer(group: str = "day_str") -> Scorer:
    """Naive Bayes needs no refit: day moments combine linearly with the multiplicities."""
    return lambda rows, moments, design: models.score_bayes(rows, models.fit_bayes(moments, design), group=group)


def tree_scorer(names: Sequence[str], make: Callable[[], forests.Ensemble], balanced: bool, group: str = "day_str") -> Scorer:
    """Tree ensembles of all distinct resamples of a batch; a day's multiplicity counts its rows."""
    return lambda rows, moments, design: forests.fit_and_score(rows, names, design, moments, make(), balanced, group)[0]


def replicates(rows: DataFrame, names: Sequence[str], draws: DataFrame, scorer: Scorer, group: str = "day_str",
               moments: models.Moments | None = None) -> DataFrame:
    """rep, mean_auc over the replicate's valid folds; replicates without one are absent."""
    moments = moments or models.group_moments(rows, names, group)
    plan = resample_folds(draws)
    design = _designs(plan, moments.groups)
    if design.ids:
        design = models.keep_models(design, models.two_class(moments, design))
    if not design.ids:  # no fold of these replicates can be fitted
        return plan.select("rep", F.lit(None).cast("double").alias("mean_auc")).limit(0)
    aucs = metrics.roc_auc(scorer(rows, moments, design), ["model_id"]).where(F.col("auc").isNotNull()).select("model_id", "auc")
    keyed = plan.withColumn("model_id", F.concat_ws("|", "test_day", "train_key"))
    return keyed.join(aucs, "model_id").groupBy("rep").agg(F.avg("auc").alias("mean_auc"))


def fingerprint(rows: DataFrame, names: Sequence[str], draws: DataFrame, config: str, group: str = "day_str") -> str:
    """A name for what replicates depend on besides their number: the feature rows, their columns, the configuration.

    The draws of a replicate are part of each replicate's own key, so that more replicates do not change the others' keys.
    """
    columns = [group, "label", *names]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("s")).first()
    return hashlib.md5(repr((config, columns, sums["n"], sums["s"])).encode()).hexdigest()


def resumable_replicates(rows: DataFrame, names: Sequence[str], draws: DataFrame, scorer: Scorer, path: str, config: str,
                         n_rep: int, group: str = "day_str", chunk: int = REPS_PER_CHUNK) -> DataFrame:
    """Replicates appended to `path` chunk by chunk; a rerun only computes those that are not there yet.

    A stored replicate counts if its number, the days drawn for it and the fingerprint of rows, names and config agree
    with what is asked for; whatever else the path holds is neither used nor returned. config names the scorer.
    """
    spark = rows.sparkSession
    moments = models.group_moments(rows, names, group)
    target = f"{path}/config={config}/of={fingerprint(rows, names, draws, config, group)}"
    days = F.array_sort(F.collect_list(F.struct("slot", "day")))  # n_days rows a replicate
    wanted = draws.where(F.col("rep") < n_rep).groupBy("rep").agg(F.md5(F.to_json(days)).alias("drawn"))

    def stored() -> DataFrame:
        try:
            return spark.read.schema("rep int, drawn string, mean_auc double").option("recursiveFileLookup", "true").parquet(target)
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" in str(error):
                return spark.createDataFrame([], "rep int, drawn string, mean_auc double")
            raise

    missing = sorted(r.rep for r in wanted.join(stored(), ["rep", "drawn"], "left_anti").select("rep").collect())  # numbers of replicates
    for at in range(0, len(missing), chunk):
        some = missing[at:at + chunk]
        out = replicates(rows, names, draws.where(F.col("rep").isin(some)), scorer, group, moments)
        wanted.where(F.col("rep").isin(some)).join(out, "rep", "left").select("rep", "drawn", "mean_auc").coalesce(1).write.parquet(f"{target}/{uuid.uuid4().hex}")
    found = stored().join(wanted, ["rep", "drawn"]).groupBy("rep").agg(F.max("mean_auc").alias("mean_auc"))  # one row each, also after a clash of writers
    return found.where(F.col("mean_auc").isNotNull())


def interval(values: DataFrame, value: str = "mean_auc", keys: Sequence[str] = ()) -> DataFrame:
    """Number, mean and 2.5/97.5 percentiles; a group holds one number per replicate."""
    return values.groupBy(*keys).agg(
        F.count(value).alias("n_valid"), F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.025)).alias("ci_low"), F.percentile(value, F.lit(0.975)).alias("ci_high"),
    )


def paired_difference(baseline: DataFrame, candidate: DataFrame, cross_population: bool = False) -> DataFrame:
    """Candidate minus baseline over replicates valid in both."""
    both = baseline.select("rep", F.col("mean_auc").alias("b")).join(candidate.select("rep", F.col("mean_auc").alias("c")), "rep")
    diffs = both.where(F.col("b").isNotNull() & F.col("c").isNotNull()).withColumn("diff", F.col("c") - F.col("b"))
    return diffs.agg(
        F.count("*").alias("n_paired"), F.avg("diff").alias("mean_diff"),
        F.percentile("diff", F.lit(0.025)).alias("ci_low"), F.percentile("diff", F.lit(0.975)).alias("ci_high"),
        F.avg(F.when(F.col("diff") > 0, 100.0).otherwise(0.0)).alias("pct_better"),
    ).withColumn("cross_population", F.lit(cross_population)).withColumn("significant", F.col("ci_low") > 0)


def intervals_overlap(a: DataFrame, b: DataFrame) -> bool:
    x, y = a.first(), b.first()
    return not (x.ci_high < y.ci_low or y.ci_high < x.ci_low)


def large_enough(n_common: int, n_full: int, share: float = 0.70) -> bool:
    """Run the bootstrap on a common subset only if it keeps enough of the full population."""
    return n_full > 0 and n_common / n_full >= share


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items not recorded yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def same_days(a: DataFrame, b: DataFrame, group: str = "day_str") -> DataFrame:
    """Days present in only one of two tables, with the side."""
    x, y = a.select(group).distinct(), b.select(group).distinct()
    return x.exceptAll(y).withColumn("only_in", F.lit("left")).unionByName(y.exceptAll(x).withColumn("only_in", F.lit("right")))


def population_mismatch(a: DataFrame, b: DataFrame, shared: Sequence[str], tolerance: float = 1e-9, key: str = "window_id") -> DataFrame:
    """Rows on which two feature tables of one population disagree: missing, other label or day, or a shared feature off."""
    l, r = a.alias("l"), b.alias("r")
    off = F.lit(False)
    for n in shared:
        x, y = F.col(f"l.{n}"), F.col(f"r.{n}")
        off = off | (F.abs(x - y) > tolerance * (1 + F.abs(y))) | (x.isNull() != y.isNull())
    differs = ~F.col("l.label").eqNullSafe(F.col("r.label")) | ~F.col("l.day_str").eqNullSafe(F.col("r.day_str"))
    joined = l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    return joined.where(differs | F.coalesce(off, F.lit(False))).select(F.coalesce(f"l.{key}", f"r.{key}").alias(key))
