"""Comparisons of feature sets and classifiers on feature tables (window_id, day_str, label, end_t, features)."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetide.operators import bootstrap, cleaning, metrics, models, validation
from kinetide.operators.features import drop_unreliable, select_aligned
from kinetide.session import cut_lineage
from kinetide.sources import storage

# Fixed values of the experiments.
BUFFERS_MS = (7_000, 5_000, 3_000)
N_REPLICATES = 200
AUGMENTATION_SETS = {"jitter": ["jitter"], "magnitude_warp": ["magnitude_warp"], "time_warp": ["time_warp"],
                     "combined": ["jitter", "magnitude_warp", "time_warp"]}
MATCH_WIDTH_MS = 600_000

Table = tuple[DataFrame, list[str]]
Evaluator = Callable[[DataFrame, Sequence[str]], DataFrame]


def _conditional(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return validation.conditional(validation.by_time(rows, MATCH_WIDTH_MS), names, MATCH_WIDTH_MS, t="end_t")


CLASSIFIERS: dict[str, Evaluator] = {
    "lr_l2_baseline": lambda rows, names: validation.logistic(rows, names),
    "gaussian_nb": lambda rows, names: validation.bayes(rows, names),
    "rf_shallow": lambda rows, names: validation.trees(rows, names, validation.forest, balanced=True),
    "gbt_shallow": lambda rows, names: validation.trees(rows, names, validation.boosting, balanced=False),
    "nested_elasticnet": lambda rows, names: validation.elastic_net(rows, names)[0],
    "conditional_logit": _conditional,
    # the standard training run
    "lr": lambda rows, names: validation.logistic(rows, names, C=1.0),
    "rf": lambda rows, names: validation.trees(rows, names, validation.full_forest, balanced=True),
    "gbt": lambda rows, names: validation.trees(rows, names, validation.deep_boosting, balanced=False),
}
TREES = {"rf_shallow": (validation.forest, True), "gbt_shallow": (validation.boosting, False), "rf": (validation.full_forest, True), "gbt": (validation.deep_boosting, False)}
STANDARD = ("lr", "rf", "gbt")


BOOTSTRAP_FORMS: dict[str, Callable[[Sequence[str]], bootstrap.Scorer]] = {
    "lr_l2_baseline": bootstrap.logistic_scorer,
    "gaussian_nb": lambda names: bootstrap.bayes_scorer(),
    "rf_shallow": lambda names: bootstrap.tree_scorer(names, validation.forest, balanced=True),
    "gbt_shallow": lambda names: bootstrap.tree_scorer(names, validation.boosting, balanced=False),
    "lr": lambda names: bootstrap.logistic_scorer(names, C=1.0),
    "rf": lambda names: bootstrap.tree_scorer(names, validation.full_forest, balanced=True),
    "gbt": lambda names: bootstrap.tree_scorer(names, validation.deep_boosting, balanced=False),
}


def result_row(scored: DataFrame, n_samples: int, **tags) -> DataFrame:
    """One row for the result log: tags, mean and std of auc and f1, and the folds."""
    folds = metrics.fold_scores(scored, ["model_id"]).select(F.struct("model_id", "auc", "f1").alias("s"), "auc", "f1")
    ordered = F.array_sort(F.collect_list("s"))
    row = folds.agg(
        F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"),
        F.transform(ordered, lambda s: s["auc"]).alias("fold_aucs"), F.transform(ordered, lambda s: s["f1"]).alias("fold_f1s"),
    )
    return row.withColumns({k: F.lit(v) for k, v in {**tags, "n_samples": n_samples}.items()})


def sweep(spark: SparkSession, tables: dict[str, Table], log: str, classifiers: Sequence[str] = tuple(CLASSIFIERS),
          prior: tuple[list[str], list[float]] | None = None, flipped: tuple[list[str], list[float]] | None = None,
          dirty: Table | None = None, all_negatives: Table | None = None, augmented: dict[str, Table] | None = None) -> DataFrame:
    """Every feature set with every classifier, then priors, weights and augmentations; rows already logged are skipped."""
    done = _logged(spark, log)

    def record(part: str, feature_set: str, model: str, rows: DataFrame, score: Callable[[], DataFrame | tuple[DataFrame, DataFrame]],
               lam: int | None = None, **more) -> None:
        """score gives scored rows, or those and the parameters that each fold chose."""
        if (part, feature_set, model, lam) in done:
            return
        extra = more if lam is None else {**more, "lam": lam}
        found = score()
        scored, choice = found if isinstance(found, tuple) else (found, None)
        row = result_row(scored, rows.count(), part=part, feature_set=feature_set, model=model, **extra)
        if choice is not None:
            chosen = [F.array(F.lit(r.l1_ratio), F.lit(r.C)) for r in choice.orderBy("model_id").collect()]  # one row per fold
            row = row.withColumn("chosen_params_per_fold", F.array(*chosen))
        storage.append_results(row, log)

    for name, (rows, columns) in tables.items():
        for kind in classifiers:
            if kind == "nested_elasticnet":
                record("models", name, kind, rows, lambda: validation.elastic_net(rows, columns))
                continue
            record("models", name, kind, rows, lambda: CLASSIFIERS[kind](rows, columns))
    for part, given in (("prior_original", prior), ("prior_flipped", flipped)):
        if given is None:
            continue
        rows = tables["A"][0]
        wanted = [lam for lam in validation.PRIOR_LAMBDAS if (part, "A", "informed_prior", lam) not in done]
        if wanted:
            scored = cut_lineage(validation.informed(rows, given[0], given[1], wanted))
            for lam in wanted:
                record(part, "A", "informed_prior", rows, lambda: scored.where(F.col("lam") == lam), lam)
    if dirty is not None:
        n_dirty = dirty[0].where((F.col("label") == 1) & (F.col("weight") < 1)).count()
        record("weights", "A", "lr_dirty_weighted", dirty[0], lambda: validation.logistic(*dirty, weight="weight"), n_dirty_positives=n_dirty)
    if all_negatives is not None:
        record("weights", "A", "lr_all_negatives", all_negatives[0], lambda: validation.logistic(*all_negatives))
    for kind, table in (augmented or {}).items():
        record("augmentation", "A", f"lr_{kind}", table[0], lambda: augmented_logistic(*table))
    return storage.read_results(spark, log)


def _logged(spark: SparkSession, log: str) -> set[tuple]:
    try:
        seen = spark.read.schema(storage.RESULT_SCHEMA).json(log).select("part", "feature_set", "model", "lam").distinct().collect()
    except Exception as error:
        if storage.missing_path(error):
            return set()
        raise
    return {tuple(r) for r in seen}  # one entry per configuration


def augmented_logistic(rows: DataFrame, names: Sequence[str], C: float = validation.BASELINE_C) -> DataFrame:
    """Leave-one-day-out fits on originals and copies, imputed from training rows; only originals are scored.

    Each fold carries its own imputation, so a fold's rows get the fold in their group name and the fold's model gives
    weight to its own rows only.
    """
    originals = rows.where(F.col("augmentation") == "none")
    _, base = validation.folds(originals, names)
    spread = rows.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in base.ids]))).withColumn("is_train", F.col("day_str") != F.col("fold"))
    filled = cut_lineage(cleaning.clean_by_training_rows(spread, names).withColumn("grp", F.concat_ws("|", "fold", "day_str")))
    moments = models.group_moments(filled, names, "grp")
    weights = np.array([[float(g.startswith(f"{i}|") and g != f"{i}|{i}") for g in moments.groups] for i in base.ids])
    design = models.Design(base.ids, moments.groups, weights, [f"{i}|{i}" for i in base.ids])
    fitted = models.fit_logistic(filled, names, design, moments, C=C, balanced=True, group="grp")
    return models.score_linear(filled.where(F.col("augmentation") == "none"), fitted, group="grp")


def train_and_select(rows: DataFrame, names: Sequence[str], kinds: Sequence[str] = STANDARD, store: str | None = None) -> tuple[str, DataFrame, DataFrame]:
    """Best classifier by mean AUC over day folds (first maximum), then its result on the held-out last day.

    store: a folder for the fold results, the report and the winner without the last day: parameters, or a table of tree nodes.
    """
    spark = rows.sparkSession
    scored = {k: cut_lineage(CLASSIFIERS[k](rows, names)) for k in kinds}
    table = None
    for i, kind in enumerate(kinds):
        row = validation.evaluate(scored[kind]).withColumn("model", F.lit(kind)).withColumn("pos", F.lit(i))
        table = row if table is None else table.unionByName(row)
    table = cut_lineage(table)
    best = metrics.first_best(table, "pos").first()["model"]
    last = metrics.last_day(rows)
    strength = {"lr": 1.0, "lr_l2_baseline": validation.BASELINE_C}.get(best)
    if strength is not None:
        held = validation.holdout(rows, names, C=strength)
    elif best in TREES:
        held = validation.trees(rows, names, *TREES[best], test_groups=[last])
    else:
        held = scored[best].where(F.col("model_id") == last)  # its fold of the last day
    report = cut_lineage(validation.holdout_report(rows, held))
    if store is not None:
        table.write.mode("overwrite").parquet(f"{store}/cross_validation")
        report.withColumn("model", F.lit(best)).write.mode("overwrite").parquet(f"{store}/held_out")
        if strength is not None:
            fitted = validation.fit_all(rows.where(F.col("day_str") != last), names, strength)
            storage.write_model(spark, fitted, f"{store}/model")
        elif best in TREES:
            make, balanced = TREES[best]
            grown = validation.grow_all(rows.where(F.col("day_str") != last), names, make(), balanced)
            grown.to_frame(spark).write.mode("overwrite").parquet(f"{store}/model_trees")
    return best, table, report


def population_prior(rows: DataFrame, names: Sequence[str], path: str | None = None) -> tuple[list[str], list[float], models.Fitted]:
    """L2 fit (C = 1, unweighted) of the pooled participants on features that carry over; names and raw coefficients.

    path: where the prior is written, as `storage.read_prior` reads it.
    """
    kept = [n for n in names if n in drop_unreliable(rows.select(*names)).columns]
    fitted = validation.fit_all(rows, kept, C=1.0, balanced=False)
    if path is not None:
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day_str").alias("people"), F.avg("label").alias("rate")).first()
        storage.write_prior(rows.sparkSession, fitted, path, [n for n in names if n not in kept], seen.n, seen.people, seen.rate, 1.0)
    return kept, list((fitted.coef / fitted.scale)[0]), fitted


def paired_bootstrap(baseline: Table, candidates: dict[str, Table], scorer: Callable[[Sequence[str]], bootstrap.Scorer] = bootstrap.logistic_scorer,
                     n_rep: int = N_REPLICATES, seed: int = 42, matched: bool = True, path: str | None = None) -> DataFrame:
    """Candidates against a baseline on shared day draws; `path` keeps replicate chunks for resuming."""
    rows, names = baseline
    draws = cut_lineage(bootstrap.day_draws(rows, n_rep, seed))

    def reps(tag: str, table: Table) -> DataFrame:
        if path is None:
            return cut_lineage(bootstrap.replicates(table[0], table[1], draws, scorer(table[1])))
        return bootstrap.resumable_replicates(table[0], table[1], draws, scorer(table[1]), path, tag, n_rep)

    base = reps("baseline", baseline)
    out = None
    for tag, table in candidates.items():
        row = bootstrap.paired_difference(base, reps(tag, table), not matched).withColumn("candidate", F.lit(tag))
        out = row if out is None else out.unionByName(row)
    return out


def buffer_sweep(build: Callable[[int], Table], kind: str = "gbt", n_rep: int = 100) -> tuple[DataFrame, DataFrame]:
    """One table per buffer: fold results of a classifier, and paired differences against the first buffer."""
    tables = {b: build(b) for b in BUFFERS_MS}
    results = None
    for buffer, (rows, names) in tables.items():
        row = result_row(CLASSIFIERS[kind](rows, names), rows.count(), part="buffer", feature_set=str(buffer), model=kind)
        results = row if results is None else results.unionByName(row)
    first = BUFFERS_MS[0]
    pairs = paired_bootstrap(tables[first], {str(b): tables[b] for b in BUFFERS_MS[1:]}, BOOTSTRAP_FORMS[kind], n_rep, matched=False)
    return results, pairs


def with_and_without(base: Table, extra: Table, kinds: Sequence[str] = ("gbt", "lr_l2_baseline"), n_rep: int = N_REPLICATES) -> tuple[DataFrame, DataFrame]:
    """A table against itself plus further features of the same windows; the populations must be the same.

    Results name the features that only the wider table has; pairs compare both tables with each classifier.
    """
    rows, names = base
    wide = cut_lineage(rows.join(extra[0].select("window_id", *extra[1]), "window_id"))
    if not bootstrap.population_mismatch(rows, wide, names).isEmpty():
        raise ValueError("the two tables do not describe the same windows")
    tables = {"without": (rows, names), "with": (wide, [*names, *extra[1]])}
    results, pairs = None, None
    for kind in kinds:
        for tag, table in tables.items():
            row = result_row(CLASSIFIERS[kind](*table), rows.count(), part="extra", feature_set=tag, model=kind)
            row = row.withColumn("added", F.array(*[F.lit(n) for n in added_features(names, table[1])]).cast("array<string>"))
            results = row if results is None else results.unionByName(row)
        pair = paired_bootstrap(base, {"with": tables["with"]}, BOOTSTRAP_FORMS[kind], n_rep).withColumn("model", F.lit(kind))
        pairs = pair if pairs is None else pairs.unionByName(pair)
    return results, pairs


def added_features(before: Sequence[str], after: Sequence[str]) -> list[str]:
    """Names that only the second table has, in its order."""
    return [n for n in after if n not in set(before)]


def heart_comparison(configs: dict[str, DataFrame], ids: Sequence[str], n_full: int, n_rep: int = N_REPLICATES) -> tuple[DataFrame, DataFrame | None]:
    """The four cardiac configurations on one population; the bootstrap only runs if enough of it is left.

    Its rows hold each configuration's own interval, and the paired difference against A_only of the others.
    """
    tables = {k: (cut_lineage(df), [c for c in df.columns if c not in ids]) for k, df in configs.items()}
    n = tables["A_only"][0].count()
    results = None
    for tag, (rows, names) in tables.items():
        row = result_row(validation.logistic(rows, names), n, part="heart", feature_set=tag, model="lr_l2_baseline")
        results = row if results is None else results.unionByName(row)
    if not bootstrap.large_enough(n, n_full):
        return results, None
    pairs = paired_bootstrap(tables["A_only"], {k: t for k, t in tables.items() if k != "A_only"}, n_rep=n_rep)
    draws, own = cut_lineage(bootstrap.day_draws(tables["A_only"][0], n_rep)), None
    for tag, (rows, names) in tables.items():
        row = bootstrap.interval(bootstrap.replicates(rows, names, draws, bootstrap.logistic_scorer(names))).withColumn("candidate", F.lit(tag))
        row = row.withColumnsRenamed({"mean": "own_mean", "ci_low": "own_low", "ci_high": "own_high"})
        own = row if own is None else own.unionByName(row)
    return results, own.join(pairs, "candidate", "left")  # a row for each configuration


def stacked(build: Callable[[str, int, bool], Table], sets: Sequence[str] = ("B", "D"), buffers: Sequence[int] = BUFFERS_MS,
            kinds: Sequence[str] = ("rf_shallow", "lr_l2_baseline"), n_rep: int = 100) -> tuple[DataFrame, DataFrame]:
    """Feature set x buffer x variability features x classifier; with each classifier the paired effect of the variability
    features, and that of the shortest buffer against the first."""
    results, pairs = None, None

    def pair(plain: Table, other: Table, tag: str, matched: bool) -> None:
        nonlocal pairs
        for kind in kinds:
            diff = paired_bootstrap(plain, {tag: other}, BOOTSTRAP_FORMS[kind], n_rep, matched=matched).withColumn("model", F.lit(kind))
            pairs = diff if pairs is None else pairs.unionByName(diff)

    for name in sets:
        of: dict[int, Table] = {}
        for buffer in buffers:
            plain, heart = build(name, buffer, False), build(name, buffer, True)
            for tag, (rows, names) in (("plain", plain), ("hrv", heart)):
                for kind in kinds:
                    row = result_row(CLASSIFIERS[kind](rows, names), rows.count(), part="stacked", feature_set=f"{name}@{buffer}+{tag}", model=kind)
                    results = row if results is None else results.unionByName(row)
            pair(plain, heart, f"{name}@{buffer}+hrv", True)
            of[buffer] = plain
        if len(of) > 1:
            pair(of[buffers[0]], of[buffers[-1]], f"{name}@{buffers[-1]}", False)
    return results, pairs


def evaluate_prior(rows: DataFrame, names: Sequence[str], prior_names: Sequence[str], prior_raw: Sequence[float], n_rep: int = N_REPLICATES) -> dict:
    """All features, the prior's features, the penalty sweep, both bootstraps, and the coefficient shift at the best penalty."""
    spark = rows.sparkSession
    shared = select_aligned(rows, ["window_id", "day_str", "label"], list(prior_names))
    sweep_ = cut_lineage(validation.evaluate(validation.informed(shared, prior_names, prior_raw), ["lam"]))
    best = metrics.first_best(sweep_, "lam").first()["lam"]
    draws = cut_lineage(bootstrap.day_draws(rows, n_rep))
    plain = bootstrap.interval(bootstrap.replicates(shared, prior_names, draws, bootstrap.logistic_scorer(prior_names)))
    pulled = bootstrap.interval(bootstrap.replicates(shared, prior_names, draws, bootstrap.logistic_scorer(prior_names, prior_raw=prior_raw, lam=best)))
    plain, pulled = cut_lineage(plain), cut_lineage(pulled)
    base_fit = validation.fit_all(shared, prior_names, C=validation.BASELINE_C).coefficients(spark)
    prior_fit = validation.fit_all(shared, prior_names, C=1.0, balanced=False, l2=2.0 * best, prior_raw=prior_raw).coefficients(spark)
    return {
        "all_features": validation.evaluate(validation.logistic(rows, names)),
        "prior_features": validation.evaluate(validation.logistic(shared, prior_names)),
        "sweep": sweep_, "best_lam": best, "bootstrap_baseline": plain, "bootstrap_informed": pulled,
        "overlap": bootstrap.intervals_overlap(plain, pulled), "shift": metrics.coefficient_shift(base_fit, prior_fit),
    }


def sign_flip(rows: DataFrame, names: Sequence[str], original: tuple[list[str], list[float]], flipped: tuple[list[str], list[float]], n_rep: int = N_REPLICATES) -> dict:
    """Does the prior from sign-flipped axes come closer to the personal fit? The sweep only follows if it helps."""
    if original[0] != flipped[0]:
        raise ValueError("the two priors name different features")
    spark = rows.sparkSession
    shared = select_aligned(rows, ["window_id", "day_str", "label"], original[0])
    fitted = validation.fit_all(shared, original[0], C=validation.BASELINE_C)
    table = [(n, float(b), float(o * s), float(f * s)) for n, b, s, o, f in zip(original[0], fitted.coef[0], fitted.scale[0], original[1], flipped[1])]
    outcomes = metrics.flip_outcomes(spark.createDataFrame(table, "feature string, baseline double, original double, flipped double"))
    summary = metrics.flip_summary(outcomes)
    out = {"outcomes": outcomes, "summary": summary, "evaluation": None}
    if summary.first()["helps"]:
        out["evaluation"] = evaluate_prior(rows, names, flipped[0], flipped[1], n_rep)
    return out


def top_bootstrap(spark: SparkSession, log: str, tables: dict[str, Table], n_rep: int = N_REPLICATES, k: int = 5) -> DataFrame:
    """Marginal bootstrap of the best logged configurations that have a bootstrap form, plus the reference (A, baseline)."""
    best = metrics.top_configs(storage.read_results(spark, log).where(F.col("feature_set").isin(list(tables))), k).collect()
    chosen = [(r.feature_set, r.model) for r in best if r.model in BOOTSTRAP_FORMS]
    out = None
    for feature_set, model in dict.fromkeys([*chosen, ("A", "lr_l2_baseline")]):
        rows, names = tables[feature_set]
        reps = bootstrap.replicates(rows, names, bootstrap.day_draws(rows, n_rep), BOOTSTRAP_FORMS[model](names))
        row = bootstrap.interval(reps).withColumn("config", F.lit(f"{feature_set}/{model}"))
        out = row if out is None else out.unionByName(row)
    return out


def deployable(rows: DataFrame, names: Sequence[str], path: str) -> models.Fitted:
    """Fit on every row and store scaler, coefficients and training medians."""
    fitted = validation.fit_all(rows, names, C=validation.BASELINE_C)
    medians = {r.feature: r["median"] for r in cleaning.feature_medians(rows, names).collect()}
    storage.write_model(rows.sparkSession, fitted, path, medians)
    return fitted
