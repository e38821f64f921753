import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetide.operators import bootstrap, matching, metrics, models, validation

NAMES = ["a", "b", "c"]


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])))


def newton(x, y, w, C=1.0, l2=1.0, centre=0.0, intercept=True):
    """Plain penalised logistic fit."""
    u = np.column_stack([np.ones(len(x)), x]) if intercept else x
    pen = np.full(u.shape[1], l2)
    if intercept:
        pen[0] = 0
    c = np.zeros(u.shape[1])
    c[int(intercept):] = centre
    b = c.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-u @ b))
        g = C * u.T @ (w * (p - y)) + pen * (b - c)
        h = C * (u.T * (w * p * (1 - p))) @ u + np.diag(pen)
        step = np.linalg.solve(h, g)
        b = b - step
        if np.abs(step).max() < 1e-12:
            break
    return b


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 240
    x = rng.normal(0, 1, (n, 3)) * [1, 20, 0.1] + [0, 500, 3]
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 500) / 30)))).astype(int)
    day = np.array([f"d{i % 5}" for i in range(n)])
    y[(day == "d4")] = 1  # a day with one class
    frame = pd.DataFrame(x, columns=NAMES).assign(label=y, day_str=day, window_id=[f"w{i}" for i in range(n)], idx=range(n), t=rng.permutation(n) * 7)
    frame["w"] = np.where(np.arange(n) % 3 == 0, 0.5, 1.0)
    return frame, spark.createDataFrame(frame).repartition(3).persist()


def balanced(y):
    n1 = y.sum()
    return np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))


def standard(tr, te):
    m, s = tr.mean(0), tr.std(0)
    return (tr - m) / s, (te - m) / s


def folds(frame):
    for d in sorted(frame.day_str.unique()):
        tr, te = frame[frame.day_str != d], frame[frame.day_str == d]
        if te.label.nunique() == 2:
            yield d, tr, te


@pytest.mark.parametrize("weight", [None, "w"])
def test_logistic_folds(data, weight):
    frame, rows = data
    got = {r.model_id: r for r in metrics.fold_scores(validation.logistic(rows, NAMES, C=0.3, weight=weight), ["model_id"]).collect()}
    want = {}
    for d, tr, te in folds(frame):
        a, b = standard(tr[NAMES].to_numpy(), te[NAMES].to_numpy())
        y = tr.label.to_numpy()
        w = balanced(y) * (tr[weight].to_numpy() if weight else 1)
        beta = newton(a, y, w, C=0.3)
        z = beta[0] + b @ beta[1:]
        tp = ((z > 0) & (te.label == 1)).sum()
        want[d] = (auc(te.label.to_numpy(), z), 2 * tp / ((z > 0).sum() + te.label.sum()))
    assert set(got) == set(want) == {"d0", "d1", "d2", "d3"}
    for d, (a, f) in want.items():
        assert got[d].auc == pytest.approx(a, abs=1e-9) and got[d].f1 == pytest.approx(f, abs=1e-9)


def test_coefficients_match_plain_newton(data):
    frame, rows = data
    fitted = validation.fit_all(rows, NAMES, C=1.0, balanced=False)
    x = frame[NAMES].to_numpy()
    b = newton((x - x.mean(0)) / x.std(0), frame.label.to_numpy(), np.ones(len(x)))
    assert fitted.converged.all()
    np.testing.assert_allclose(np.r_[fitted.intercept, fitted.coef[0]], b, atol=1e-8)


def test_prior_limits(data):
    """No penalty gives the maximum likelihood fit; a huge one returns the prior in fold units."""
    frame, rows = data
    x = frame[NAMES].to_numpy()
    scale = x.std(0)
    raw = np.array([0.5, -0.01, 2.0])
    free = validation.fit_all(rows, NAMES, C=1.0, balanced=False, l2=0.0, prior_raw=raw)
    np.testing.assert_allclose(free.coef[0], newton((x - x.mean(0)) / scale, frame.label.to_numpy(), np.ones(len(x)), l2=0.0)[1:], atol=1e-6)
    held = validation.fit_all(rows, NAMES, C=1.0, balanced=False, l2=1e9, prior_raw=raw)
    np.testing.assert_allclose(held.coef[0], raw * scale, atol=1e-4)
    mid = validation.fit_all(rows, NAMES, C=1.0, balanced=False, l2=20.0, prior_raw=raw)
    np.testing.assert_allclose(mid.coef[0], newton((x - x.mean(0)) / scale, frame.label.to_numpy(), np.ones(len(x)), l2=20.0, centre=raw * scale)[1:], atol=1e-7)
    tests = models.wald_tests(free)
    u = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / scale])
    p = 1 / (1 + np.exp(-(free.intercept[0] + u[:, 1:] @ free.coef[0])))
    se = np.sqrt(np.diag(np.linalg.inv((u.T * (p * (1 - p))) @ u)))[1:]
    np.testing.assert_allclose([t["se"] for t in tests], se, rtol=1e-5)


def test_informed_cv(data):
    frame, rows = data
    raw = np.array([0.5, -0.01, 2.0])
    scored = validation.informed(rows, NAMES, raw, [1, 50])
    got = {(r.lam, r.model_id.split("|")[1]): r.auc for r in metrics.roc_auc(scored, ["lam", "model_id"]).collect()}
    for d, tr, te in folds(frame):
        a, b = standard(tr[NAMES].to_numpy(), te[NAMES].to_numpy())
        for lam in (1, 50):
            beta = newton(a, tr.label.to_numpy(), np.ones(len(tr)), l2=2 * lam, centre=raw * tr[NAMES].to_numpy().std(0))
            assert got[(float(lam), d)] == pytest.approx(auc(te.label.to_numpy(), b @ beta[1:]), abs=1e-9)


def test_elastic_net_is_optimal(data):
    """The subgradient conditions hold for every penalty mix."""
    frame, rows = data
    x = frame[NAMES].to_numpy()
    v = (x - x.mean(0)) / x.std(0)
    moments = models.group_moments(rows, NAMES)
    one = np.ones(len(moments.groups))
    grid = [(r, c) for r in validation.L1_RATIOS for c in (0.01, 0.05, 1.0)]
    design = models.Design([str(g) for g in grid], moments.groups, np.tile(one, (len(grid), 1)), [""] * len(grid))
    r, c = np.array([g[0] for g in grid]), np.array([g[1] for g in grid])
    fitted = models.fit_logistic(rows, NAMES, design, moments, C=c, l2=1 - r, l1=r, balanced=True)
    w = balanced(frame.label.to_numpy())
    for k in range(len(grid)):
        b = fitted.coef[k]
        q = 1 / (1 + np.exp(-(fitted.intercept[k] + v @ b)))
        g = c[k] * v.T @ (w * (q - frame.label.to_numpy())) + (1 - r[k]) * b
        assert abs((w * (q - frame.label.to_numpy())).sum()) < 1e-5
        for j in range(3):
            if abs(b[j]) > 1e-9:
                assert g[j] + r[k] * np.sign(b[j]) == pytest.approx(0, abs=1e-5)
            else:
                assert abs(g[j]) <= r[k] + 1e-6
    assert (fitted.coef == 0).any()


def test_nested_elastic_net_choice(data):
    frame, rows = data
    scored, choice = validation.elastic_net(rows, NAMES)
    assert {x.model_id for x in choice.collect()} == {"d0", "d1", "d2", "d3"}
    assert metrics.fold_scores(scored, ["model_id"]).count() == 4


def pairs_by_hand(frame):
    out = []
    for d, part in frame.groupby("day_str"):
        neg = part[part.label == 0].sort_values("idx")
        for _, p in part[part.label == 1].iterrows():
            if len(neg):
                gaps = (neg.t - p.t).abs().to_numpy()
                out.append((d, int(p.idx), int(neg.idx.to_numpy()[np.argmin(gaps)])))
    return sorted(out)


def test_nearest_controls(spark, data):
    frame, rows = data
    for scale in (1, 50):  # many ties when the clock is coarse
        coarse = frame.assign(t=frame.t // scale)
        got = matching.nearest_controls(spark.createDataFrame(coarse[["day_str", "idx", "t", "label"]]), 11)
        assert sorted((r.day_str, r.case_idx, r.control_idx) for r in got.collect()) == pairs_by_hand(coarse)


def test_conditional_logit(data):
    frame, rows = data
    got = {r.model_id: r.auc for r in metrics.roc_auc(validation.conditional(rows, NAMES, 50), ["model_id"]).collect()}
    by_idx = frame.set_index("idx")[NAMES]
    for d, tr, te in folds(frame):
        pairs = [(p, n) for g, p, n in pairs_by_hand(tr)]
        diff = (by_idx.loc[[p for p, _ in pairs]].to_numpy() - by_idx.loc[[n for _, n in pairs]].to_numpy()) / tr[NAMES].to_numpy().std(0)
        beta = newton(np.r_[diff, -diff], np.r_[np.ones(len(diff)), np.zeros(len(diff))], np.ones(2 * len(diff)), intercept=False)
        assert got[d] == pytest.approx(auc(te.label.to_numpy(), standard(tr[NAMES].to_numpy(), te[NAMES].to_numpy())[1] @ beta), abs=1e-9)


def bayes(tr, te):
    x, y = tr[NAMES].to_numpy(), tr.label.to_numpy()
    a, b = standard(x, te[NAMES].to_numpy())
    out = []
    for c in (0, 1):
        m, v = a[y == c].mean(0), a[y == c].var(0) + 1e-9 * a.var(0).max()
        out.append(np.log((y == c).mean()) - 0.5 * (np.log(v) + (b - m) ** 2 / v).sum(1))
    return out[1] - out[0]


@pytest.mark.parametrize("kind", ["bayes", "logistic"])
def test_bootstrap_replicates(data, kind, tmp_path):
    frame, rows = data
    draws = bootstrap.day_draws(rows, 12)
    scorer = bootstrap.bayes_scorer() if kind == "bayes" else bootstrap.logistic_scorer(NAMES, C=0.5)
    got = {r.rep: r.mean_auc for r in bootstrap.replicates(rows, NAMES, draws, scorer).collect()}
    drawn = draws.toPandas()
    want = {}
    for rep, part in drawn.groupby("rep"):
        days = list(part.day)
        scores = []
        for d in sorted(set(days)):
            rest = [x for x in days if x != d]
            if not rest:
                continue
            tr, te = pd.concat([frame[frame.day_str == x] for x in rest]), frame[frame.day_str == d]
            if tr.label.nunique() < 2 or te.label.nunique() < 2:
                continue
            if kind == "bayes":
                z = bayes(tr, te)
            else:
                a, b = standard(tr[NAMES].to_numpy(), te[NAMES].to_numpy())
                beta = newton(a, tr.label.to_numpy(), balanced(tr.label.to_numpy()), C=0.5)
                z = b @ beta[1:]
            scores.append(auc(te.label.to_numpy(), z))
        if scores:
            want[rep] = np.mean(scores)
    assert set(got) == set(want)
    for rep in want:
        assert got[rep] == pytest.approx(want[rep], abs=1e-8)
    if kind == "bayes":
        path = str(tmp_path)
        run = lambda n, some=draws, by=scorer, table=rows: {
            r.rep: r.mean_auc for r in bootstrap.resumable_replicates(table, NAMES, some, by, path, "x", n, chunk=2).collect()}
        assert run(3) == {r: pytest.approx(v) for r, v in want.items() if r < 3}
        assert run(7) == {r: pytest.approx(v) for r, v in want.items() if r < 7}  # resumed inside a chunk
        assert run(12) == {r: pytest.approx(v) for r, v in want.items()}
        broken = lambda *a: pytest.fail("finished replicates must not run again")
        assert run(12, by=broken) == {r: pytest.approx(v) for r, v in want.items()} and set(run(4, by=broken)) == {r for r in want if r < 4}
        other = bootstrap.day_draws(rows, 4, seed=7)
        direct = {r.rep: r.mean_auc for r in bootstrap.replicates(rows, NAMES, other, scorer).collect()}
        assert run(4, some=other) == {r: pytest.approx(v) for r, v in direct.items()}  # other draws are other replicates


def test_auc_ties_and_missing_class(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"k": rng.integers(0, 3, 3000), "score": rng.integers(0, 40, 3000) / 7, "label": rng.integers(0, 2, 3000)})
    frame.loc[frame.k == 2, "label"] = 1
    got = {r.k: r.auc for r in metrics.roc_auc(spark.createDataFrame(frame), ["k"]).collect()}
    for k in (0, 1):
        part = frame[frame.k == k]
        assert got[k] == pytest.approx(auc(part.label.to_numpy(), part.score.to_numpy()), abs=1e-12)
    assert got[2] is None


def test_trees_score_every_fold(data):
    frame, rows = data
    few = lambda: validation.forest(trees=20)
    clear = rows.withColumn("label", (F.col("a") > 0).cast("int"))  # one feature decides, so every fold must find it
    scores = metrics.fold_scores(validation.trees(clear, NAMES, few, balanced=True), ["model_id"]).collect()
    assert len(scores) == 5 and min(r.auc for r in scores) > 0.95
    assert validation.trees(rows, NAMES, few, balanced=True).select("model_id").distinct().count() == 4
    boost = validation.trees(rows, NAMES, lambda: validation.boosting(trees=5), balanced=False, test_groups=["d1"])
    assert boost.count() == (frame.day_str == "d1").sum()
    draws = bootstrap.day_draws(rows, 1)
    assert bootstrap.replicates(rows, NAMES, draws, bootstrap.tree_scorer(NAMES, few, True)).count() == 1


def test_passes_use_all_cores(spark):
    """Rows that came in one task are spread, and few rows are not."""
    rows = spark.range(0, 9000, 1, 1)
    assert models._spread(rows, 9000).rdd.getNumPartitions() > 1
    assert models._spread(rows, 100).rdd.getNumPartitions() == 1


def test_conditional_rows_are_numbered_once(spark, monkeypatch):
    """The matched fit reads its rows many times, so their order by time is not found anew each time."""
    from kinetide.plans import queries

    seen = []
    kept = queries.validation.conditional
    monkeypatch.setattr(queries.validation, "conditional", lambda rows, *a, **k: seen.append(rows) or kept(rows, *a, **k))
    queries.conditional_fold_scores(spark, "/root/testdata/sf0.001")
    assert "Window" not in seen[0]._jdf.queryExecution().logical().toString()
