"""Trees of many folds at once against plain loops."""
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetide.operators import bootstrap, forests, models, validation

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(160, 4)), 2)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.7, 160) > 0.8).astype(int)
    return pd.DataFrame({"id": range(160), "day_str": [f"d{i % 4}" for i in range(160)], "label": y, **{n: x[:, i] for i, n in enumerate(NAMES)}})


def split(bins, features, n, a, b, kind):
    best = None
    for f in features:
        for cut in range(forests.BINS):
            left = bins[:, f] <= cut
            ln, la, lb, rn, ra, rb = (float(v[s].sum()) for s in (left, ~left) for v in (n, a, b))
            if ln < kind.leaf or rn < kind.leaf:
                continue
            if kind.boosting:
                gain = ln * rn / (ln + rn) * (la / ln - ra / rn) ** 2
            else:
                gain = (la * la + lb * lb) / (la + lb) + (ra * ra + rb * rb) / (ra + rb)
            if gain > 0 and (best is None or gain > best[0] * (1 + 1e-12)):
                best = gain, f, cut
    return best and best[1:]


def tree(bins, n, a, b, kind, number, path=1, depth=0):
    """Values of a tree as a function of binned rows."""
    value = forests._value(kind, int(a.sum()), int(b.sum()))
    may = depth < kind.depth and (path == 1 or n.sum() >= 2 * kind.leaf) and (kind.boosting or a.sum() and b.sum())
    found = split(bins, forests._chosen(kind, number, path, bins.shape[1]), n, a, b, kind) if may else None
    if found is None:
        return lambda x: np.full(len(x), value)
    f, cut = found
    left = bins[:, f] <= cut
    sides = [tree(bins[s], n[s], a[s], b[s], kind, number, 2 * path + i, depth + 1) for i, s in enumerate((left, ~left))]
    return lambda x: np.where(x[:, f] <= cut, sides[0](x), sides[1](x))


def plain(frame, kind, balanced, fold):
    x, y, day = frame[NAMES].to_numpy(), frame.label.to_numpy(), frame.day_str.to_numpy()
    cuts = [np.unique(np.quantile(x[:, i], [k / forests.BINS for k in range(1, forests.BINS)])) for i in range(4)]
    bins = np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)])
    train, test = day != fold, day == fold
    counts = np.bincount(y[train], minlength=2)
    if kind.boosting:
        margin = np.full(len(y), round(math.log(counts[1] / counts[0]) * forests.VALUE_UNIT))
        for t in range(kind.trees):
            q = 1 / (1 + np.exp(-margin / forests.VALUE_UNIT))
            g, h = (np.rint(v * forests.GRADIENT_UNIT).astype(int) for v in (y - q, q * (1 - q)))
            margin = margin + tree(bins[train], np.ones(train.sum(), int), g[train], h[train], kind, t)(bins)
        return 1 / (1 + np.exp(-margin[test] / forests.VALUE_UNIT))
    weight = np.rint(counts.sum() / (2 * counts) * forests.CLASS_UNIT).astype(int) if balanced else [forests.CLASS_UNIT] * 2
    key = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) for i in frame.id])
    total = 0
    for t in range(kind.trees):
        a, b = forests._draw(kind.seed, t)
        times = np.searchsorted(forests.POISSON, (key * a + b) % forests.PRIME, side="right")
        on = train & (times > 0)
        zero, one = (np.where(y == c, times * weight[c], 0) for c in (0, 1))
        total = total + tree(bins[on], np.ones(on.sum(), int), zero[on], one[on], kind, t)(bins[test])
    return total / (kind.trees * forests.VALUE_UNIT)


@pytest.mark.parametrize("kind, balanced", [
    (validation.forest(trees=12, leaf=3), True), (validation.full_forest(trees=4), False), (validation.boosting(trees=7, leaf=4), False), (validation.deep_boosting(trees=3), False),
])
def test_scores_equal_plain_loops(spark, monkeypatch, frame, kind, balanced):
    monkeypatch.setattr(forests, "ROUNDS_KEPT", 3)
    rows = spark.createDataFrame(frame).repartition(3)
    got = validation.trees(rows, NAMES, lambda: kind, balanced, key=F.col("id")).toPandas()
    assert sorted(got.model_id.unique()) == ["d0", "d1", "d2", "d3"]
    for fold in ("d0", "d3"):
        assert np.sort(got.score[got.model_id == fold]) == pytest.approx(np.sort(plain(frame, kind, balanced, fold)), abs=1e-9)


def test_partitions_and_blocks_do_not_matter(spark, monkeypatch, frame):
    rows = spark.createDataFrame(frame)
    scores = lambda r: sorted(validation.trees(r, NAMES, lambda: validation.forest(trees=10), True, key=F.col("id")).collect())
    first = scores(rows.repartition(1))
    assert scores(rows.repartition(7)) == first
    monkeypatch.setattr(forests, "CELLS", 600)  # sparse histograms, one model a block
    monkeypatch.setattr(forests, "AT_ONCE", 5000)
    assert scores(rows.repartition(2)) == first


def test_multiplicity_counts_rows(spark, frame):
    rows = spark.createDataFrame(frame)
    moments = models.group_moments(rows, NAMES)
    kind = validation.boosting(trees=3, leaf=4)
    design = models.Design(["twice"], moments.groups, np.array([[2.0, 1.0, 1.0, 0.0]]), ["d3"])
    got = forests.fit_and_score(rows, NAMES, design, moments, kind, False)[0].toPandas().score
    twice = rows.unionByName(rows.where("day_str = 'd0'"))
    cuts = forests.cut_points(rows, NAMES)
    again = models.group_moments(twice, NAMES)
    data = forests._binned(twice, NAMES, cuts, "day_str", again.groups, None)
    grown = forests.fit(twice, NAMES, models.Design(["once"], again.groups, np.array([[1.0, 1.0, 1.0, 0.0]]), ["d3"]), again, kind, False, data=data, cuts=cuts)
    assert np.sort(forests.score(data, grown).toPandas().score) == pytest.approx(np.sort(got), abs=1e-12)


@pytest.mark.parametrize("kind", [validation.forest(trees=9), validation.boosting(trees=4)])
def test_stored_trees_score_as_grown(spark, tmp_path, frame, kind):
    rows = spark.createDataFrame(frame)
    moments, design = validation.folds(rows, NAMES)
    scored, grown = forests.fit_and_score(rows, NAMES, design, moments, kind, True)
    grown.to_frame(spark).write.parquet(str(tmp_path / "trees"))
    again = forests.score_stored(rows, spark.read.parquet(str(tmp_path / "trees")), ["day_str"], kind.boosting).where("model_id = day_str")
    assert sorted(r.score for r in again.collect()) == pytest.approx(sorted(r.score for r in scored.collect()), abs=1e-6)


def test_resamples_are_grown_together(spark, frame):
    rows = spark.createDataFrame(frame)
    reps = bootstrap.replicates(rows, NAMES, bootstrap.day_draws(rows, 3), bootstrap.tree_scorer(NAMES, lambda: validation.forest(trees=10), True))
    assert reps.count() >= 2 and all(0 <= r.mean_auc <= 1 for r in reps.collect())


def test_rows_of_one_split_are_spread(spark, monkeypatch):
    """A table that is read in one task gives passes with several, and the same trees."""
    rows = spark.range(0, 9000, 1, 1).selectExpr(
        "concat('d', id % 3) as day_str", "cast(id * 7919 % 1000 > 480 + id % 5 * 10 as int) as label", "id * 7919 % 1000 / 10D as a", "id % 5 * 1D as b")
    parts = []
    kept = forests.cut_lineage
    monkeypatch.setattr(forests, "cut_lineage", lambda df: parts.append(kept(df)) or parts[-1])
    moments, design = validation.folds(rows, ["a", "b"])
    kind = validation.boosting(trees=2)
    spread = forests.fit(rows, ["a", "b"], design, moments, kind, False).trees
    assert parts[0].rdd.getNumPartitions() > 1
    whole = forests.fit(rows, ["a", "b"], design, moments, kind, False, data=parts[0].coalesce(1)).trees
    nodes = [sorted(zip(t.model, t.tree, t.path, t.feature, t.cut, t.value)) for t in (spread, whole)]
    assert nodes[0] == nodes[1] and len(nodes[0]) > 6
