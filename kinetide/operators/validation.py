"""Leave-one-day-out evaluation of every classifier kind. Each function returns one scored row per test row and model."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinetide.operators import forests, metrics, models
from kinetide.operators.matching import nearest_controls
from kinetide.operators.ordered import row_numbers, time_bucket

# Fixed grids of the evaluations.
L1_RATIOS = (0.0, 0.5, 1.0)
STRENGTHS = (0.01, 0.1, 1.0)
PRIOR_LAMBDAS = (1, 5, 20, 50, 100, 300, 1000, 5000)
BASELINE_C = 0.01


def folds(rows: DataFrame, names: Sequence[str], group: str = "day_str") -> tuple[models.Moments, models.Design]:
    moments = models.group_moments(rows, names, group)
    design = models.leave_one_out(moments.groups)
    return moments, models.keep_models(design, models.two_class(moments, design))


def logistic(rows: DataFrame, names: Sequence[str], C: float = BASELINE_C, weight: str | None = None, group: str = "day_str",
             keep: Sequence[str] = ()) -> DataFrame:
    """L2 logistic regression with balanced classes (and optional row weights)."""
    moments, design = folds(rows, names, group)
    fitted = models.fit_logistic(rows, names, design, moments, C=C, balanced=True, weight=weight, group=group)
    return models.score_linear(rows, fitted, keep, group)


def bayes(rows: DataFrame, names: Sequence[str], group: str = "day_str", keep: Sequence[str] = ()) -> DataFrame:
    moments, design = folds(rows, names, group)
    return models.score_bayes(rows, models.fit_bayes(moments, design), keep, group)


def informed(rows: DataFrame, names: Sequence[str], prior_raw: Sequence[float], lambdas: Sequence[float] = PRIOR_LAMBDAS,
             group: str = "day_str") -> DataFrame:
    """MAP logistic regression pulled toward a raw-unit prior; all penalties and folds in one batch (adds `lam`)."""
    moments, base = folds(rows, names, group)
    k = len(lambdas)
    design = models.Design(
        [f"{lam}|{i}" for lam in lambdas for i in base.ids], base.groups, np.tile(base.weights, (k, 1)), base.test_group * k
    )
    lam = np.repeat(np.asarray(lambdas, float), len(base.ids))
    fitted = models.fit_logistic(rows, names, design, moments, C=1.0, l2=2.0 * lam, prior_raw=np.asarray(prior_raw, float), group=group)
    scored = models.score_linear(rows, fitted, group=group, closed=True)
    return scored.withColumn("lam", F.substring_index("model_id", "|", 1).cast("double"))


def elastic_net(rows: DataFrame, names: Sequence[str], group: str = "day_str", weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nested search: inner day folds choose (l1_ratio, C) per outer fold, then one refit. Returns scores and choices."""
    spark = rows.sparkSession
    moments, outer = folds(rows, names, group)
    at = {g: i for i, g in enumerate(moments.groups)}
    grid = [(r, c) for r in L1_RATIOS for c in STRENGTHS]
    ids, weights, tests, ratio, strength = [], [], [], [], []
    for o, outer_id in enumerate(outer.ids):
        days = [g for g in moments.groups if outer.weights[o, at[g]] > 0]
        for inner in days if len(days) >= 2 else []:
            w = outer.weights[o].copy()
            w[at[inner]] = 0.0
            if not ((w @ moments.n > 0).all() and (moments.n[at[inner]] > 0).all()):
                continue
            for k, (r, c) in enumerate(grid):
                ids.append(f"{o}|{k}|{inner}")
                weights.append(w)
                tests.append(inner)
                ratio.append(r)
                strength.append(c)
    best: dict[int, int] = {}
    if ids:
        r, c = np.array(ratio), np.array(strength)
        inner_fit = models.fit_logistic(
            rows, names, models.Design(ids, moments.groups, np.array(weights), tests), moments, C=c, l2=1 - r, l1=r,
            balanced=True, weight=weight, group=group, tol=1e-6,
        )
        aucs = metrics.roc_auc(models.score_linear(rows, inner_fit, group=group), ["model_id"])
        means = aucs.select(
            F.split("model_id", r"\|")[0].cast("int").alias("o"), F.split("model_id", r"\|")[1].cast("int").alias("k"), "auc"
        ).groupBy("o", "k").agg(F.avg("auc").alias("auc"))
        first = F.row_number().over(W.partitionBy("o").orderBy(F.col("auc").desc(), "k"))
        best = {row.o: row.k for row in means.withColumn("rn", first).where("rn = 1").collect()}  # one row per outer fold
    chosen = [grid[best[o]] if o in best else (0.5, 0.1) for o in range(len(outer.ids))]
    r, c = np.array([p[0] for p in chosen]), np.array([p[1] for p in chosen])
    fitted = models.fit_logistic(rows, names, outer, moments, C=c, l2=1 - r, l1=r, balanced=True, weight=weight, group=group, tol=1e-7)
    choice = spark.createDataFrame([(i, *map(float, p)) for i, p in zip(outer.ids, chosen)], "model_id string, l1_ratio double, C double")
    return models.score_linear(rows, fitted, group=group), choice


def by_time(rows: DataFrame, width: int, group: str = "day_str", t: str = "end_t") -> DataFrame:
    """rows with `idx`, their place in the group by time, then window_id: the order in which ties between controls are settled."""
    return row_numbers(rows.withColumn("__b", time_bucket(t, width)), [group], "__b", [t, "window_id"], "idx").drop("__b")


def conditional(rows: DataFrame, names: Sequence[str], width: int, group: str = "day_str", idx: str = "idx", t: str = "t") -> DataFrame:
    """1:1 matched conditional logit: each positive against its nearest same-day negative, fitted on the differences."""
    moments, design = folds(rows, names, group)
    keyed = rows.withColumn("day_str", F.col(group).cast("string"))
    pairs = nearest_controls(keyed.select("day_str", F.col(idx).alias("idx"), F.col(t).alias("t"), "label"), width)
    values = keyed.select("day_str", F.col(idx).alias("__i"), *[F.col(n).cast("double").alias(n) for n in names])
    case, control = values.alias("case"), values.alias("control")
    diffs = (
        pairs.alias("pair").join(case, (F.col("case_idx") == F.col("case.__i")) & (F.col("pair.day_str") == F.col("case.day_str")))
        .join(control, (F.col("control_idx") == F.col("control.__i")) & (F.col("pair.day_str") == F.col("control.day_str")))
        .select(F.col("pair.day_str").alias("day_str"), F.lit(1).alias("label"), F.lit(2.0).alias("pair_weight"), *[(F.col(f"case.{n}") - F.col(f"control.{n}")).alias(n) for n in names])
    ).persist()
    per_day = {r.day_str: r["count"] for r in diffs.groupBy("day_str").count().collect()}  # one number per day
    n_pairs = design.weights @ np.array([per_day.get(g, 0) for g in design.groups], float)
    design = models.keep_models(design, n_pairs >= 3)
    _, mean, var = moments.combine(design.weights)
    scale = np.where(var > 0, np.sqrt(var), 1.0)
    fitted = models.fit_logistic(
        diffs, names, design, moments, C=1.0, l2=1.0, weight="pair_weight", intercept=False,
        scaling=(np.zeros_like(mean), scale), group="day_str",
    )
    diffs.unpersist()
    fitted.mean = mean  # test rows are standardised, so the margin is (x - mean) / scale * b
    return models.score_linear(rows, fitted, group=group, closed=True)


def forest(seed: int = 42, **options) -> forests.Ensemble:
    return forests.Ensemble(**{**dict(trees=200, depth=3, leaf=8, seed=seed), **options})


def boosting(seed: int = 42, **options) -> forests.Ensemble:
    return forests.Ensemble(**{**dict(trees=100, depth=2, leaf=8, boosting=True, rate=0.05, seed=seed), **options})


def full_forest(seed: int = 42, **options) -> forests.Ensemble:
    """200 trees down to single rows or 30 levels."""
    return forest(seed, **{**dict(depth=30, leaf=1), **options})


def deep_boosting(seed: int = 42, **options) -> forests.Ensemble:
    """200 rounds of depth 3."""
    return boosting(seed, **{**dict(trees=200, depth=3, leaf=1, rate=0.1), **options})


def trees(rows: DataFrame, names: Sequence[str], make: Callable[[], forests.Ensemble], balanced: bool, group: str = "day_str",
          test_groups: Sequence[str] | None = None, key: Column | None = None) -> DataFrame:
    """Tree ensembles of all folds, grown together; the scores are written before they are returned."""
    moments, design = folds(rows, names, group)
    design = models.keep_models(design, np.array([test_groups is None or g in test_groups for g in design.test_group], bool))
    return forests.fit_and_score(rows, names, design, moments, make(), balanced, group, key)[0]


def grow_all(rows: DataFrame, names: Sequence[str], kind: forests.Ensemble, balanced: bool, group: str = "day_str") -> forests.Grown:
    """One tree ensemble on every row, as `fit_all` for linear models."""
    moments = models.group_moments(rows, names, group)
    design = models.Design(["all"], moments.groups, np.ones((1, len(moments.groups))), [""])
    return forests.fit(rows, names, design, moments, kind, balanced, group)


def holdout(rows: DataFrame, names: Sequence[str], group: str = "day_str", test_day: str | None = None, C: float = BASELINE_C) -> DataFrame:
    """Train on all other days, score the held-out one (default: the last)."""
    moments = models.group_moments(rows, names, group)
    design = models.leave_one_out(moments.groups)
    design = models.keep_models(design, np.array([g == (test_day or moments.groups[-1]) for g in design.ids]))
    fitted = models.fit_logistic(rows, names, design, moments, C=C, balanced=True, group=group)
    return models.score_linear(rows, fitted, group=group)


def holdout_report(rows: DataFrame, scored: DataFrame, group: str = "day_str") -> DataFrame:
    """test_day, n_train, n_test, auc, f1, precision, recall."""
    sizes = rows.groupBy(F.col(group).cast("string").alias("model_id")).agg(F.count("*").alias("n_test"))
    total = rows.count()
    scores = metrics.roc_auc(scored, ["model_id"]).select("model_id", "auc").join(metrics.threshold_metrics(scored, ["model_id"]), "model_id")
    return scores.join(sizes, "model_id").select(
        F.col("model_id").alias("test_day"), (F.lit(total) - F.col("n_test")).alias("n_train"), "n_test", "auc", "f1", "precision", "recall"
    )


def fit_all(rows: DataFrame, names: Sequence[str], C: float, balanced: bool = True, group: str = "day_str",
            l2: float = 1.0, prior_raw: Sequence[float] | None = None) -> models.Fitted:
    """One model on every row (deployable fit, population prior, coefficient tables)."""
    moments = models.group_moments(rows, names, group)
    design = models.Design(["all"], moments.groups, np.ones((1, len(moments.groups))), [""])
    prior = None if prior_raw is None else np.asarray(prior_raw, float)
    return models.fit_logistic(rows, names, design, moments, C=C, l2=l2, prior_raw=prior, balanced=balanced, group=group)


def evaluate(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and std of auc and f1 over the folds of a scored table."""
    by_fold = metrics.fold_scores(scored, [*keys, "model_id"])
    return metrics.cv_summary(by_fold, keys)
