"""Feature tables, caches, result logs and model parameters on storage."""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetide.operators.models import Fitted

# The columns of the live logs.
EVAL_FIELDS = ["eval_idx", "utc_iso", "timestamp_ms", "n_samples_in_window", "probability", "alert_fired", "suppressed_by_cooldown"]
OUTCOME_FIELDS = ["utc_iso", "timestamp_ms", "event", "matched_alert_idx", "seconds_since_alert"]
RESULT_SCHEMA = (
    "part string, feature_set string, model string, mean_auc double, std_auc double, mean_f1 double, std_f1 double, "
    "fold_aucs array<double>, fold_f1s array<double>, lam int, n_samples long, n_dirty_positives long, "
    "chosen_params_per_fold array<array<double>>, timestamp string"
)


def missing_path(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error)


def write_features(df: DataFrame, path: str, feature_set: str, names: Sequence[str]) -> None:
    """Feature table partitioned by day; the column order is kept in a one-row table next to it."""
    df.write.mode("overwrite").partitionBy("day_str").parquet(f"{path}/feature_set={feature_set}")
    spark = df.sparkSession
    spark.createDataFrame([(list(names),)], "feature_names array<string>").write.mode("overwrite").parquet(f"{path}/_names/{feature_set}")


def read_features(spark: SparkSession, path: str, feature_set: str) -> tuple[DataFrame, list[str]]:
    names = spark.read.parquet(f"{path}/_names/{feature_set}").first().feature_names
    table = spark.read.parquet(f"{path}/feature_set={feature_set}")
    return table.withColumn("day_str", F.col("day_str").cast("string")), list(names)


def cached_features(spark: SparkSession, path: str, feature_set: str, build: Callable[[], tuple[DataFrame, list[str]]],
                    options: dict | None = None, inputs: str = "") -> tuple[DataFrame, list[str]]:
    """Build a feature set once for given options (buffer, window, ...) and inputs (`packets.listing`); later calls read the stored table."""
    if options or inputs:
        feature_set = f"{feature_set}-{hashlib.md5(repr((sorted((options or {}).items()), inputs)).encode()).hexdigest()}"
    try:
        return read_features(spark, path, feature_set)
    except Exception as error:
        if not missing_path(error):
            raise
    table, names = build()
    write_features(table, path, feature_set, names)
    return read_features(spark, path, feature_set)


def append_results(results: DataFrame, path: str) -> None:
    results.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("append").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Usable results: sanity rows and rows without AUC are skipped."""
    log = spark.read.schema(RESULT_SCHEMA).json(path)
    return log.where(F.col("mean_auc").isNotNull() & ~F.isnan("mean_auc") & ~F.coalesce(F.col("part").startswith("sanity"), F.lit(False)))


def pending(configs: DataFrame, spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Configurations that have no row in the log yet."""
    try:
        done = spark.read.schema(RESULT_SCHEMA).json(path).select(*keys).distinct()
    except Exception as error:
        if missing_path(error):
            return configs
        raise
    return configs.join(done, list(keys), "left_anti")


def write_model(spark: SparkSession, fitted: Fitted, path: str, medians: dict[str, float] | None = None, model: int = 0) -> None:
    """Parameter table: position, feature, mean, scale, coef, intercept and the training median."""
    medians = medians or {}
    rows = [
        (i, n, float(fitted.mean[model, i]), float(fitted.scale[model, i]), float(fitted.coef[model, i]),
         float(fitted.intercept[model]), medians.get(n))
        for i, n in enumerate(fitted.names)
    ]
    spark.createDataFrame(rows, "pos int, feature string, mean double, scale double, coef double, intercept double, median double") \
        .coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> dict:
    """names, mean, scale, coef, intercept, medians of a stored model (one row per feature)."""
    rows = spark.read.parquet(path).orderBy("pos").collect()
    return {
        "names": [r.feature for r in rows], "mean": [r["mean"] for r in rows], "scale": [r.scale for r in rows],
        "coef": [r.coef for r in rows], "intercept": rows[0].intercept, "medians": {r.feature: r["median"] for r in rows},
    }


def read_prior(spark: SparkSession, path: str) -> tuple[list[str], list[float]]:
    """Feature names and raw-unit coefficients of a population prior in JSON."""
    schema = (
        "feature_names array<string>, excluded_features array<string>, coefficients_population_std_units array<double>, "
        "intercept_population_std_units double, population_scaler_mean array<double>, population_scaler_scale array<double>, "
        "n_samples long, n_participants long, positive_rate double, sklearn_C double"
    )
    row = spark.read.schema(schema).option("multiLine", "true").json(path).first()
    raw = [c / s for c, s in zip(row.coefficients_population_std_units, row.population_scaler_scale)]
    return list(row.feature_names), raw


def write_prior(spark: SparkSession, fitted: Fitted, path: str, excluded: Sequence[str], n_samples: int, n_participants: int, positive_rate: float, strength: float) -> None:
    """A population prior as JSON: coefficients in units of the population's deviations, its scaler, and what it was fitted on."""
    row = {
        "feature_names": list(fitted.names), "excluded_features": list(excluded), "coefficients_population_std_units": fitted.coef[0].tolist(),
        "intercept_population_std_units": float(fitted.intercept[0]), "population_scaler_mean": fitted.mean[0].tolist(), "population_scaler_scale": fitted.scale[0].tolist(),
        "n_samples": n_samples, "n_participants": n_participants, "positive_rate": float(positive_rate), "sklearn_C": float(strength),
    }
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)
