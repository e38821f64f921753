"""Batched weighted classifiers: many small models (folds, penalties, bootstrap resamples) over one distributed table.

A model differs from its siblings in the weight it gives to each group (day), in its penalty and in its prior.
Group moments are one native aggregate. Each Newton pass is one job for all models of a block: tasks reduce their
rows to a gradient and a curvature per model, Spark sums those, and the driver solves d x d systems. Rows never
leave the executors; what the driver holds is models x d^2 and is kept below BLOCK_NUMBERS per pass.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK_NUMBERS = 4_000_000
MOMENT_NUMBERS = 50_000_000
ROWS_OF_TASK, MOST_OF_TASK = 1 << 11, 1 << 18  # rows that are worth a task of a pass, and that it has at most


@dataclass
class Moments:
    """Count, mean and population variance of every feature per group and class."""

    names: list[str]
    groups: list[str]
    n: np.ndarray  # groups x 2
    mean: np.ndarray  # groups x 2 x d
    var: np.ndarray

    def combine(self, weights: np.ndarray, label: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted n, mean and variance per model; weights is models x groups."""
        pick = slice(None) if label is None else slice(label, label + 1)
        n, mean, var = self.n[:, pick], self.mean[:, pick], self.var[:, pick]
        d = mean.shape[-1]
        w = (weights[:, :, None] * n[None]).reshape(len(weights), -1)
        flat_mean, flat_var = mean.reshape(-1, d), var.reshape(-1, d)
        total = w.sum(1)
        safe = np.where(total > 0, total, 1.0)[:, None]
        centre = flat_mean.mean(0)
        shift = w @ (flat_mean - centre) / safe
        spread = w @ (flat_var + (flat_mean - centre) ** 2) / safe - shift**2
        return total, centre + shift, np.maximum(spread, 0.0)

    def class_counts(self, weights: np.ndarray) -> np.ndarray:
        return weights @ self.n


def group_moments(rows: DataFrame, names: Sequence[str], group: str = "day_str", label: str = "label") -> Moments:
    names = list(names)
    aggs = [F.count("*").alias("n")]
    aggs += [F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]
    aggs += [F.var_pop(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(names)]
    table = rows.groupBy(F.col(group).cast("string").alias("g"), F.col(label).cast("int").alias("y")).agg(*aggs)
    found = table.limit(MOMENT_NUMBERS // (2 * len(names)) + 1).toPandas()
    if len(found) > MOMENT_NUMBERS // (2 * len(names)):
        raise ValueError("too many groups for batched fits; use coarser groups")
    groups = sorted(found["g"].unique())
    at = {g: i for i, g in enumerate(groups)}
    d = len(names)
    out = Moments(names, groups, np.zeros((len(groups), 2)), np.zeros((len(groups), 2, d)), np.zeros((len(groups), 2, d)))
    means, variances = found[[f"m{i}" for i in range(d)]].to_numpy(float), found[[f"v{i}" for i in range(d)]].to_numpy(float)
    for k, (g, y, n) in enumerate(zip(found["g"], found["y"], found["n"])):
        out.n[at[g], y], out.mean[at[g], y], out.var[at[g], y] = n, means[k], variances[k]
    return out


@dataclass
class Design:
    """Models to fit: ids, weights per group, and the group each model is tested on."""

    ids: list[str]
    groups: list[str]
    weights: np.ndarray
    test_group: list[str]
    tags: list[dict] = field(default_factory=list)


def leave_one_out(groups: Sequence[str]) -> Design:
    groups = list(groups)
    return Design(groups, groups, 1.0 - np.eye(len(groups)), groups, [{"fold": g} for g in groups])


def keep_models(design: Design, keep: np.ndarray) -> Design:
    index = np.flatnonzero(keep)
    return Design([design.ids[i] for i in index], design.groups, design.weights[index],
                  [design.test_group[i] for i in index], [design.tags[i] for i in index] if design.tags else [])


def two_class(moments: Moments, design: Design) -> np.ndarray:
    """Which models train and test on both classes."""
    at = {g: i for i, g in enumerate(moments.groups)}
    test = np.array([moments.n[at[g]] if g in at else [0, 0] for g in design.test_group]).reshape(-1, 2)
    return (moments.class_counts(design.weights) > 0).all(1) & (test > 0).all(1)


@dataclass
class Fitted:
    """Linear models on standardised features."""

    names: list[str]
    design: Design
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray
    converged: np.ndarray
    curvature: np.ndarray | None = None

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """model_id, test_group, intercept and coefficients in raw feature units."""
        raw = self.coef / self.scale
        offset = self.intercept - (raw * self.mean).sum(1)
        schema = "model_id string, test_group string, offset double, coefs array<double>"
        rows = [(i, g, float(o), [float(v) for v in c]) for i, g, o, c in zip(self.design.ids, self.design.test_group, offset, raw)]
        return spark.createDataFrame(rows, schema)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Long form: model_id, feature, coef (standardised units), mean, scale."""
        rows = [
            (m, n, float(self.coef[i, j]), float(self.mean[i, j]), float(self.scale[i, j]))
            for i, m in enumerate(self.design.ids) for j, n in enumerate(self.names)
        ]
        return spark.createDataFrame(rows, "model_id string, feature string, coef double, mean double, scale double")


def _soft(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0.0)


def _step(g: np.ndarray, h: np.ndarray, beta: np.ndarray, centre: np.ndarray, l2: np.ndarray, l1: np.ndarray, free: bool) -> np.ndarray:
    """Next coefficients: Newton step of the smooth part, with coordinate sweeps where an absolute penalty applies."""
    m, p = beta.shape
    ridge = np.repeat(l2[:, None], p, 1)
    ridge[:, 0] = 0.0
    full = h + np.einsum("mi,ij->mij", ridge, np.eye(p))
    full += 1e-10 * np.eye(p) * (1 + np.einsum("mii->mi", h).mean(1))[:, None, None]
    slope = g + ridge * (beta - centre)
    if not free:
        slope[:, 0] = 0.0
        full[:, 0, :] = full[:, :, 0] = 0.0
        full[:, 0, 0] = 1.0
    new = beta - np.linalg.solve(full, slope[:, :, None])[:, :, 0]
    lasso = np.flatnonzero(l1 > 0)
    if len(lasso):
        a, b0, s, t = full[lasso], beta[lasso], slope[lasso], l1[lasso]
        b = b0.copy()
        residual = s + np.einsum("mij,mj->mi", a, b - b0)
        for _ in range(400):
            largest = 0.0
            for j in range(p):
                if j == 0 and not free:
                    continue
                target = b[:, j] - residual[:, j] / a[:, j, j]
                value = target if j == 0 else _soft(target, t / a[:, j, j])
                move = value - b[:, j]
                if np.any(move):
                    residual += a[:, :, j] * move[:, None]
                    b[:, j] = value
                    largest = max(largest, float(np.abs(move).max()))
            if largest < 1e-9:
                break
        new[lasso] = b
    return new


def _objective(loss, beta, centre, l2, l1):
    away = beta[:, 1:] - centre[:, 1:]
    return loss + 0.5 * l2 * (away**2).sum(1) + l1 * np.abs(beta[:, 1:]).sum(1)


def fit_logistic(
    rows: DataFrame,
    names: Sequence[str],
    design: Design,
    moments: Moments,
    C: float | np.ndarray = 1.0,
    l2: float | np.ndarray = 1.0,
    l1: float | np.ndarray = 0.0,
    prior_raw: np.ndarray | None = None,
    balanced: bool = False,
    weight: str | None = None,
    intercept: bool = True,
    scaling: tuple[np.ndarray, np.ndarray] | None = None,
    group: str = "day_str",
    label: str = "label",
    max_iter: int = 60,
    tol: float = 1e-9,
) -> Fitted:
    """Minimise C * sum(w * loss) + l2/2 |b - prior|^2 + l1 |b|_1 per model on features standardised by its own training rows.

    `prior_raw` is in raw feature units (re-expressed per model as prior x scale). `balanced` uses n / (2 n_class)
    of the model's (multiplicity-weighted) rows. `weight` names a row weight column.
    """
    m, d = len(design.ids), len(names)
    c_all, l2_all, l1_all = (np.broadcast_to(np.asarray(v, float), (m,)).copy() for v in (C, l2, l1))
    if scaling is None:
        _, mean, var = moments.combine(design.weights)
        sd = np.sqrt(var)
        scale = np.where(sd <= 1e-12 * np.maximum(1.0, np.abs(mean)), 1.0, sd)
    else:
        mean, scale = scaling
    class_weight = np.ones((m, 2))
    if balanced:
        counts = moments.class_counts(design.weights)
        class_weight = counts.sum(1, keepdims=True) / (2.0 * np.where(counts > 0, counts, 1.0))
    prior = np.zeros((m, d + 1))
    if prior_raw is not None:
        prior[:, 1:] = np.asarray(prior_raw) * scale
    _, mid, spread = moments.combine(np.ones((1, len(moments.groups))))
    common_mean, common_scale = mid[0], np.where(spread[0] > 0, np.sqrt(spread[0]), 1.0)
    if not intercept:
        common_mean = np.zeros(d)
    beta = prior.copy()
    converged = np.zeros(m, dtype=bool)
    curvature = np.zeros((m, d + 1, d + 1))
    per_model = (d + 1) * (d + 2) // 2 + d + 2
    block = max(1, BLOCK_NUMBERS // max(per_model, len(design.groups)))
    spread = _spread(rows.select(group, label, *names, *([weight] if weight else [])), int(moments.n.sum())).persist()
    for lo in range(0, m, block):
        part = slice(lo, min(m, lo + block))
        beta[part], converged[part], curvature[part] = _fit_block(
            spread, list(names), group, label, weight, design.groups, design.weights[part], class_weight[part],
            mean[part], scale[part], common_mean, common_scale, c_all[part], l2_all[part], l1_all[part],
            prior[part], intercept, max_iter, tol,
        )
    spread.unpersist()
    return Fitted(list(names), design, mean, scale, beta[:, 1:], beta[:, 0], converged, curvature)


def _spread(rows: DataFrame, count: int) -> DataFrame:
    """A row costs a pass far more than its bytes tell, so a table of few bytes still gets all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(cores, -(-count // ROWS_OF_TASK)), -(-count // MOST_OF_TASK)))


def _fit_block(rows, names, group, label, weight, groups, group_weights, class_weight, mean, scale,
               common_mean, common_scale, C, l2, l1, prior, intercept, max_iter, tol):
    m, d = len(C), len(names)
    # affine map from commonly scaled features u to the model's features v: v = A u + a
    ratio = common_scale / scale
    lift = np.zeros((m, d + 1, d + 1))
    lift[:, 0, 0] = 1.0
    lift[:, np.arange(1, d + 1), np.arange(1, d + 1)] = ratio
    lift[:, 1:, 0] = (common_mean - mean) / scale
    beta, old, old_value = prior.copy(), prior.copy(), np.full(m, np.inf)
    done = np.zeros(m, dtype=bool)
    curvature = np.zeros((m, d + 1, d + 1))
    halvings = np.zeros(m, dtype=int)
    for _ in range(max_iter):
        live = np.flatnonzero(~done)
        if len(live) == 0:
            break
        in_u = np.einsum("mi,mij->mj", beta[live], lift[live])
        loss, g, h = _pass(rows, names, group, label, weight, groups, group_weights[live], class_weight[live], in_u, common_mean, common_scale)
        g = C[live, None] * np.einsum("mij,mj->mi", lift[live], g)
        h = C[live, None, None] * (lift[live] @ h @ lift[live].transpose(0, 2, 1))
        value = _objective(C[live] * loss, beta[live], prior[live], l2[live], l1[live])
        worse = ~(value <= old_value[live] * (1 + 1e-12) + 1e-12)
        back = live[worse]
        beta[back] = (beta[back] + old[back]) / 2
        halvings[back] += 1
        done[back[halvings[back] > 30]] = True
        ahead, pick = live[~worse], np.flatnonzero(~worse)
        if len(ahead):
            curvature[ahead] = h[pick]
            new = _step(g[pick], h[pick], beta[ahead], prior[ahead], l2[ahead], l1[ahead], intercept)
            small = np.abs(new - beta[ahead]).max(1) < tol * (1 + np.abs(beta[ahead]).max(1))
            old[ahead], old_value[ahead], halvings[ahead] = beta[ahead], value[pick], 0
            beta[ahead] = new
            done[ahead[small]] = True
    return beta, done & (halvings <= 30), curvature


def _pass(rows, names, group, label, weight, groups, group_weights, class_weight, beta, common_mean, common_scale):
    """Loss, gradient and curvature of every model at `beta`, summed over all rows by one Spark aggregate."""
    m, p = beta.shape
    upper = np.triu_indices(p)
    at = {g: i for i, g in enumerate(groups)}
    weights_by_group = np.ascontiguousarray(group_weights.T)
    used = [group, label, *names] + ([weight] if weight else [])
    numbers = 1 + p + len(upper[0])

    step = max(256, (1 << 20) // max(m, len(upper[0])))

    def reduce_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((m, numbers))
        for whole in frames:
            for i in range(0, len(whole), step):
                frame = whole.iloc[i:i + step]
                u = np.column_stack([np.ones(len(frame)), (frame[names].to_numpy(float) - common_mean) / common_scale])
                y = frame[label].to_numpy(int)
                place = frame[group].astype(str).map(at).to_numpy()
                w = weights_by_group[place] * class_weight.T[y]
                if weight:
                    w = w * frame[weight].to_numpy(float)[:, None]
                sign = np.where(y == 1, 1.0, -1.0)[:, None]
                margin = (u @ beta.T) * sign
                small = np.exp(-np.abs(margin))
                q = np.where(margin >= 0, small, 1.0) / (1.0 + small)
                total[:, 0] += (w * (np.maximum(-margin, 0.0) + np.log1p(small))).sum(0)
                w *= q
                total[:, 1:1 + p] -= (w * sign).T @ u
                w *= 1.0 - q
                total[:, 1 + p:] += w.T @ (u[:, upper[0]] * u[:, upper[1]])
        yield pd.DataFrame({
            "model": np.repeat(np.arange(m), numbers), "pos": np.tile(np.arange(numbers), m), "value": total.ravel()
        })

    summed = (
        rows.select(*used).mapInPandas(reduce_rows, "model long, pos long, value double")
        .groupBy("model", "pos").agg(F.sum("value").alias("value")).toPandas()
    )
    out = np.zeros((m, numbers))
    out[summed["model"], summed["pos"]] = summed["value"]
    h = np.zeros((m, p, p))
    h[:, upper[0], upper[1]] = out[:, 1 + p:]
    h[:, upper[1], upper[0]] = out[:, 1 + p:]
    return out[:, 0], out[:, 1:1 + p], h


def score_linear(rows: DataFrame, fitted: Fitted, keep: Sequence[str] = (), group: str = "day_str", label: str = "label",
                 closed: bool = False) -> DataFrame:
    """Score every row with the models tested on its group: model_id, label, score, predicted.

    Predicted is p > 0.5, or p >= 0.5 if `closed`.
    """
    models = fitted.to_frame(rows.sparkSession).withColumnRenamed("test_group", "__g")
    x = F.array(*[F.col(n).cast("double") for n in fitted.names])
    joined = rows.withColumn("__g", F.col(group).cast("string")).join(models, "__g")
    products = F.zip_with(x, "coefs", lambda a, b: a * b)
    margin = F.col("offset") + F.aggregate(products, F.lit(0.0), lambda a, b: a + b)
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("__z")))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    hit = F.col("score") >= 0.5 if closed else F.col("score") > 0.5
    return joined.withColumn("__z", margin).withColumn("score", score).select(
        "model_id", *keep, F.col(label).cast("int").alias("label"), "score", hit.cast("int").alias("predicted")
    )


@dataclass
class FittedBayes:
    names: list[str]
    design: Design
    mean: np.ndarray  # models x 2 x d, raw units
    var: np.ndarray
    prior: np.ndarray  # models x 2

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Each model as a quadratic score: offset + sum(linear * x + square * x^2)."""
        inv = 1.0 / self.var
        square = 0.5 * (inv[:, 0] - inv[:, 1])
        linear = self.mean[:, 1] * inv[:, 1] - self.mean[:, 0] * inv[:, 0]
        const = 0.5 * (np.log(self.var[:, 0]) - np.log(self.var[:, 1]) + self.mean[:, 0] ** 2 * inv[:, 0] - self.mean[:, 1] ** 2 * inv[:, 1])
        offset = const.sum(1) + np.log(self.prior[:, 1]) - np.log(self.prior[:, 0])
        rows = [(i, g, float(o), l.tolist(), s.tolist()) for i, g, o, l, s in
                zip(self.design.ids, self.design.test_group, offset, linear, square)]
        return spark.createDataFrame(rows, "model_id string, test_group string, offset double, linear array<double>, square array<double>")


def fit_bayes(moments: Moments, design: Design) -> FittedBayes:
    """Gaussian naive Bayes on standardised features, from moments alone.

    The variance floor is 1e-9 of the largest standardised variance, i.e. 1e-9 x scale^2 in raw units.
    """
    total, _, var = moments.combine(design.weights)
    scale2 = np.where(var > 0, var, 1.0)
    floor = 1e-9 * (var / scale2).max(1, keepdims=True)
    parts = [moments.combine(design.weights, c) for c in (0, 1)]
    mean = np.stack([p[1] for p in parts], 1)
    spread = np.stack([p[2] + floor * scale2 for p in parts], 1)
    prior = np.stack([p[0] / np.where(total > 0, total, 1.0) for p in parts], 1)
    return FittedBayes(moments.names, design, mean, np.where(spread > 0, spread, 1e-300), prior)


def score_bayes(rows: DataFrame, fitted: FittedBayes, keep: Sequence[str] = (), group: str = "day_str", label: str = "label") -> DataFrame:
    models = fitted.to_frame(rows.sparkSession).withColumnRenamed("test_group", "__g")
    x = F.array(*[F.col(n).cast("double") for n in fitted.names])
    joined = rows.withColumn("__g", F.col(group).cast("string")).join(models, "__g")
    terms = F.zip_with(F.zip_with(x, "square", lambda a, s: a * s), "linear", lambda a, b: a + b)
    total = F.aggregate(F.zip_with(terms, x, lambda t, a: t * a), F.lit(0.0), lambda a, b: a + b)
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("offset") + total))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return joined.withColumn("score", score).select(
        "model_id", *keep, F.col(label).cast("int").alias("label"), "score", (F.col("score") > 0.5).cast("int").alias("predicted")
    )


def wald_tests(fitted: Fitted, model: int = 0) -> list[dict]:
    """Standard errors and p-values of an unpenalised fit; None when it did not converge."""
    if not fitted.converged[model]:
        return [{"feature": n, "coef": float(c), "se": None, "p": None} for n, c in zip(fitted.names, fitted.coef[model])]
    errors = np.sqrt(np.diag(np.linalg.inv(fitted.curvature[model])))[1:]
    return [
        {"feature": n, "coef": float(c), "se": float(e), "p": math.erfc(abs(c / e) / math.sqrt(2))}
        for n, c, e in zip(fitted.names, fitted.coef[model], errors)
    ]
